"""Operator 2, language identification: nearest centroid over TF-IDF n-gram vectors.

A text becomes a vector of hashed byte bigrams and trigrams of its lower-case form without ASCII
words that hold a digit (numbers, keys and addresses say nothing about a language), weighted by
log(1 + count) and by inverse document frequency, and scaled to length 1.  Every language has
several centroids, found by spherical k-means over its own documents; a text takes the
language of the centroid with the largest cosine.  A text whose cosine is under that language's
rejection limit for texts of its size is rejected: it is too far from everything that was learned.
A limit is a fixed share of a low quantile (``QUANTILE``) of the cosines of the language's own sample
and of short pieces of it, in classes of the number of distinct grams, as short texts have lower
cosines; no limit is above that of all languages together.  So a few odd rows of a sample do not
turn the rejection off.

Document frequencies cover all learning rows.  The centroids are fitted on a bounded sample:
about ``SAMPLE`` rows of each language, chosen by a hash of the id at a rate that follows from
the language's count.

Defined results: a text that is null or has no letter is ``und`` with score 0 and is rejected;
a text that shares nothing with any centroid takes the most frequent language with score 0;
rows without language are not learned from; without learning rows every text is ``und``; a text
whose words all hold digits is taken with them.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecorpus.llm import common as C

LOG_DIMS = 13
DIMS = 1 << LOG_DIMS
CENTROIDS = 4
SAMPLE = 400
#: Limits are REJECT times the QUANTILE of the cosines of a size class.
REJECT, QUANTILE = 0.5, 0.01
#: Characters of the pieces of sample texts that the limits of short texts are taken from.
PIECES = (8, 16, 32, 64, 128, 256, 512)
#: Cosines that a size class needs for a limit of its own; others take that of the class below.
CLASS_LEAST = 20
#: Share of a language's sample that a centroid needs.
LEAST_SHARE = 0.02
#: Times that small clusters are started anew.
RESTARTS = 8
#: ASCII runs with a digit; each character is looked at once.
_DIGIT_WORD = re.compile(r"(?<![!-~])[!-/:-~]*+[0-9][!-~]*+")
_KNUTH = np.uint32(2654435761)


def has_letter(text) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    words = _DIGIT_WORD.sub(" ", text)
    text = words if has_letter(words) else text
    a = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    two = a[:-1] << np.uint32(8) | a[1:]
    three = (two[:-1] << np.uint32(8) | a[2:]) + np.uint32(1 << 24)
    codes = np.concatenate([two, three]) * _KNUTH >> np.uint32(32 - LOG_DIMS)
    return np.bincount(codes.astype(np.int64), minlength=DIMS)


def vectors(texts, idf: np.ndarray) -> np.ndarray:
    x = np.empty((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        x[i] = gram_counts(t)
    np.log1p(x, out=x)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.where(norm > 0, norm, 1)[:, None]
    return x


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means with seeded k-means++ starts.  A cluster under ``LEAST_SHARE`` of
    the rows starts anew from a row of the largest one, so outliers do not use up the centroids."""
    rng = np.random.default_rng(k)
    picks = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(picks) < min(k, len(x)):
        far = np.maximum(1 - (x @ x[picks].T).max(axis=1), 0)
        far[picks] = 0
        if far.sum() < 1e-6:  # no further distinct row
            break
        picks.append(int(rng.choice(len(x), p=far / far.sum())))
    c = x[picks].copy()
    for again in range(RESTARTS + 1):
        for _ in range(rounds):
            own = np.argmax(x @ c.T, axis=1)
            for j in range(len(c)):
                if (own == j).any():
                    v = x[own == j].sum(axis=0)
                    c[j] = v / max(float(np.linalg.norm(v)), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        n = np.bincount(own, minlength=len(c))
        few = np.flatnonzero((n < LEAST_SHARE * len(x)) & (n < n.max()))
        if not len(few) or again == RESTARTS:
            break
        c[few] = x[rng.choice(np.flatnonzero(own == np.argmax(n)), len(few))]
    return np.delete(c, few, axis=0)


def size_class(x: np.ndarray) -> np.ndarray:
    """floor(log2) of the number of distinct grams of each row."""
    return np.log2(np.maximum(np.count_nonzero(x, axis=1), 1)).astype(np.int64)


def _cosines(texts: list[str], x: np.ndarray, idf: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and size classes of the texts ``x`` of a sample and of pieces of them."""
    rng = np.random.default_rng(len(PIECES))
    sims, sizes = [(x @ c.T).max(axis=1)], [size_class(x)]
    for length in PIECES:
        starts = [int(rng.integers(0, max(1, len(t) - length))) for t in texts]
        pieces = [p for t, at in zip(texts, starts, strict=True) if has_letter(p := t[at:at + length])]
        for lo in range(0, len(pieces), 64):
            v = vectors(pieces[lo:lo + 64], idf)
            sims.append((v @ c.T).max(axis=1))
            sizes.append(size_class(v))
    return np.concatenate(sims).astype(np.float64), np.concatenate(sizes)


def _limits(sims: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rejection limit of each size class."""
    out = np.zeros(LOG_DIMS + 1)
    for k in range(len(out)):
        some = sims[sizes == k]
        out[k] = REJECT * np.quantile(some, QUANTILE) if len(some) >= CLASS_LEAST else out[k - 1] if k else 0
    return out


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents in which each dimension occurs, and the number of documents."""
    def run(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for pdf in batches:
            for t in pdf["text"]:
                df += gram_counts(t) > 0
                n += 1
        at = np.flatnonzero(df)
        C.release()
        yield pd.DataFrame({"dim": np.append(at, -1), "n": np.append(df[at], n)})
    rows = docs.select("text").mapInPandas(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(DIMS, np.int64), 0
    for r in rows:  # at most DIMS + 1 rows
        if r["dim"] < 0:
            n = r["n"]
        else:
            out[r["dim"]] = r["n"]
    return out, n


def fit(train: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> dict:
    """Model from rows (doc_id, text, lang): idf, centroids (one row each), their languages and
    rejection limits (one for each size class).  Its size depends on the number of languages only."""
    train = train.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    per = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    df, n = document_frequency(train)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    model = {"idf": idf, "langs": [], "c": np.zeros((0, DIMS), np.float32), "limits": np.zeros((0, LOG_DIMS + 1)), "common": None}
    if not per:
        return model
    rate = F.create_map(*[F.lit(x) for lang, m in per.items() for x in (lang, min(1.0, sample / m))])
    part = (F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < rate[F.col("lang")]

    def cluster(key, pdf):
        pdf = pdf.sort_values(["doc_id", "text"])
        texts = list(pdf["text"])
        x = vectors(texts, idf)
        c = _kmeans(x, k)
        sims, sizes = _cosines(texts, x, idf, c)
        return pd.DataFrame({"lang": key[0], "c": [r.tobytes() for r in c], "sims": sims.tobytes(), "sizes": sizes.tobytes()})
    got = (train.where(part).groupBy("lang").applyInPandas(cluster, "lang string, c binary, sims binary, sizes binary")
           .orderBy("lang", "c").collect())
    model["langs"] = [r["lang"] for r in got]
    if got:
        model["c"] = np.stack([np.frombuffer(r["c"], np.float32) for r in got])
        of = {r["lang"]: (np.frombuffer(r["sims"]), np.frombuffer(r["sizes"], np.int64)) for r in got}
        pooled = _limits(*map(np.concatenate, zip(*of.values(), strict=True)))
        limits = {lang: np.minimum(_limits(*x), pooled) for lang, x in of.items()}
        model["limits"] = np.stack([limits[x] for x in model["langs"]])
    model["common"] = min(per, key=lambda x: (-per[x], x))
    return model


def predict(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """The columns ``keep`` with lang_pred, score (cosine, 0 to 1) and rejected.  Only ``text``
    is an input of the prediction."""
    langs, c, limits, idf, common = model["langs"], model["c"].T.copy(), model["limits"], model["idf"], model["common"]

    def run(batches):
        for pdf in batches:
            pred = np.array(["und"] * len(pdf), object)
            score, rejected = np.zeros(len(pdf)), np.ones(len(pdf), bool)
            at = [i for i, t in enumerate(pdf["text"]) if has_letter(t)]
            for lo in range(0, len(at), 64):
                some = at[lo:lo + 64]
                if not langs:
                    continue
                x = vectors([pdf["text"].iat[i] for i in some], idf)
                sims = x @ c
                best = np.argmax(sims, axis=1)
                for i, j, s, least in zip(some, best, sims[np.arange(len(some)), best], limits[best, size_class(x)], strict=True):
                    pred[i] = langs[j] if s > 0 else common
                    score[i] = min(1.0, max(0.0, float(s)))
                    rejected[i] = s < least or s <= 0
            out = pdf[list(keep)].copy()
            out["lang_pred"], out["score"], out["rejected"] = pred, score, rejected
            yield out
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keep) + (", " if keep else "") + "lang_pred string, score double, rejected boolean"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(run, schema)


def keep_known(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns.  Each distinct row
    (id, text) is judged by its text alone."""
    cols = [F.col(f"`{c}`") for c in docs.columns]

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text), bool)
        at = [i for i, t in enumerate(text) if has_letter(t)]
        for lo in range(0, len(at), 64):
            some = at[lo:lo + 64]
            if len(model["langs"]):
                x = vectors([text.iat[i] for i in some], model["idf"])
                sims = x @ model["c"].T
                best = np.argmax(sims, axis=1)
                s = sims[np.arange(len(some)), best]
                out[some] = (s > 0) & (s >= model["limits"][best, size_class(x)])
        return pd.Series(out)
    return docs.where(known("text")).select(*cols)
