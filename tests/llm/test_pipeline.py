import corpus_pipeline
import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandmill.llm import langid, pii, toxicity
from strandmill.llm.queries import KEY

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def first_of_groups(texts):
    """The ids that stay: the smallest of each group linked by a Jaccard similarity of 0.8."""
    sets, least = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]:
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {i for i in texts if root(i) == i}


def test_run_is_the_stages_in_order(spark, tmp_path):
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    private = "call +1 (826) 555-4081 190.137.223.204 <|endoftext|> "
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 3, None).when(F.col("doc_id") % 7 == 1, F.concat(F.lit(private), "text")).otherwise(F.col("text")))
    docs = docs.withColumn("start", F.lit("clash")).withColumn("label", F.lit(0)).withColumn("score", F.lit(2.0))
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")

    known = langid.identify(docs, langid.learn(docs)).where("not rejected").select("doc_id")
    left = docs.join(known, "doc_id", "left_semi")
    toxic = toxicity.score_documents(left, toxicity.learn(left, labels)).where("predicted = 1").select("doc_id")
    texts = {r["doc_id"]: r["text"] for r in left.join(toxic, "doc_id", "left_anti").select("doc_id", "text").collect()}
    library, surrogates = Tokenizer.from_file(P.path("word_bpe_49k.json")), pii.Surrogates(KEY)
    expected = {}
    for i in first_of_groups(texts):
        text = texts[i] and pii.replaced(texts[i], surrogates)[0]
        assert "190.137.223.204" not in (text or "")
        expected[i] = [*library.encode(text or "", add_special_tokens=False).ids, 1]

    got, filled = {}, {}
    for r in corpus_pipeline.run(spark, sf).orderBy("doc_id", "start").collect():
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and r["doc_tokens"] == len(expected[r["doc_id"]])
        got[r["doc_id"]] += np.frombuffer(r["ids"], "<u2").tolist()
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == expected and 50 < len(got) < docs.count()
    for pieces in filled.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_run_on_an_empty_table_and_on_repeated_rows(spark, tmp_path):
    """Nothing gives nothing; rows that repeat under one doc_id are one document to near-dedup, and each is packed."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for name, own in (("empty", docs.where("false")), ("repeated", docs.where("doc_id < 60").unionByName(docs.where("doc_id IN (0, 1, 2)")))):
        own.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.where("false" if name == "empty" else "true").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/empty")
    assert got.count() == 0 and got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, spark.read.parquet(f"{tmp_path}/empty/documents.parquet"), f"{tmp_path}/empty")
        assert left.columns == docs.columns and left.count() == 0, name
    tokens: dict = {}
    for r in corpus_pipeline.run(spark, f"{tmp_path}/repeated").collect():
        tokens.setdefault(r["doc_id"], []).append((r["length"], r["doc_tokens"]))
    times = {d: sum(n for n, _ in v) / v[0][1] for d, v in tokens.items()}
    assert set(times.values()) <= {1, 2} and all(times[d] == 1 for d in times if d > 2) and 2 in times.values()
