from pagecorpus.llm import language as L
from pagecorpus.llm import queries as Q


def test_held_out_accuracy(spark, sf_dir, documents):
    got = Q.op2_language(spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 350
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) == 0  # all of them are text


def test_odd_rows(odd, documents):
    model = L.fit(documents)
    got = {r.text: r for r in L.predict(odd, model, "doc_id", "text").collect()}
    for t in ("", None, "   \n\t ", "12345 678", "!!! ??? ..."):
        assert (got[t].lang_pred, got[t].score, got[t].rejected) == ("und", 0.0, True)
    assert got["one"].lang_pred in {"en", "de", "fr", "es"}
    assert got["中文文本 测试"].rejected  # nothing like what was learned
    assert L.predict(odd, model, "doc_id").count() == odd.count()
    kept = L.keep_known(odd, model)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()


def test_without_learning_rows(odd, nothing):
    model = L.fit(nothing)
    assert {r.lang_pred for r in L.predict(odd, model, "doc_id").collect()} == {"und"}
    assert L.predict(nothing, model, "doc_id").count() == 0 and L.keep_known(nothing, model).count() == 0


def test_prediction_depends_on_text_alone(documents):
    model = L.fit(documents)
    a = {r.doc_id: r.lang_pred for r in L.predict(documents.limit(50), model, "doc_id").collect()}
    from pyspark.sql import functions as F
    b = {r.doc_id: r.lang_pred for r in L.predict(documents.limit(50).withColumn("lang", F.lit("xx")), model, "doc_id").collect()}
    assert a == b


#: Texts in languages (and a program) that share the alphabet of the learned ones.
UNLEARNED = [
    "La mattina presto i pescatori scendono verso la spiaggia e preparano le barche. Nessuno parla molto, perché ognuno conosce già "
    "il proprio lavoro e il mare non aspetta. Quando il sole sale sopra le colline, il villaggio si sveglia.",
    "Varhain aamulla kalastajat laskeutuvat rantaan ja valmistelevat veneensä. Kukaan ei puhu paljon, koska jokainen tuntee jo työnsä "
    "eikä meri odota. Kun aurinko nousee kukkuloiden yläpuolelle, kylä herää ja kaupat avaavat ovensa.",
    "Wczesnym rankiem rybacy schodzą na plażę i przygotowują łodzie. Nikt nie mówi wiele, bo każdy zna już swoją pracę, a morze nie czeka.",
    "#include <vector>\ntemplate <typename T> struct Node { T value; Node* next; };\nint main(int argc, char** argv) {\n"
    "  std::vector<int> xs;\n  for (int i = 0; i < argc; ++i) { xs.push_back(i * 2); }\n  return xs.empty() ? 1 : 0;\n}\n"]


def test_unlearned_languages_of_the_same_alphabet_are_rejected(spark, documents):
    garbage = [(90_000 + i, " ".join(f"zq{chr(97 + i)}xj" for _ in range(40)), lang) for i, lang in enumerate(["en", "de", "fr", "es"])]
    train = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(garbage, "doc_id long, text string, lang string"))
    model = L.fit(train)
    got = L.predict(spark.createDataFrame(list(enumerate(UNLEARNED)), "doc_id long, text string"), model, "doc_id").collect()
    assert len(got) == len(UNLEARNED) and all(r.rejected for r in got)
    assert L.keep_known(documents, model).count() == documents.count()
    assert all(model["langs"].count(x) > 1 for x in ("en", "de", "fr", "es"))  # several centroids of each


def test_words_with_digits_do_not_count():
    import time

    assert (L.gram_counts("the token=ab12cd cat 4785 a.b@c1.de sat") == L.gram_counts("the   cat     sat")).sum() > L.DIMS - 20
    assert (L.gram_counts("a1 b2") > 0).sum() > 5 and (L.gram_counts("中文1文本") > 0).sum() > 10
    start = time.time()
    L.gram_counts("x" * 2_000_000)
    assert time.time() - start < 20  # linear in the length of a word


def test_kmeans_keeps_several_centroids_beside_outliers():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.zeros((403, 60), np.float32)
    x[:200, :20] = 1 + rng.random((200, 20)) / 2
    x[200:400, 10:30] = 1 + rng.random((200, 20)) / 2
    x[[400, 401, 402], [50, 51, 52]] = 1  # unlike all other rows
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = L._kmeans(x, 4)
    assert len(c) >= 2 and (c[:, 50:].max(axis=1) < 0.5).all()
    assert (x[:400] @ c.T).max(axis=1).min() > 0.95
