"""The registered queries: their columns, and equal results in SQL where SQL can express them."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import license_scan, queries

COLUMNS = {
    "op1_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op4_source_mix": "doc_id size source_size target taken",
    "op5_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_language_id": "doc_id held_out lang_pred score",
    "op9_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_quality_mil": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    res = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(res.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_for_each_document(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    assert sorted(r[0] for r in df.select("doc_id").collect()) == sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == columns and 0 < kept.count() <= n, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(5), sf_dir).count() == 5


def test_pipeline_stages_take_columns_of_any_name(spark, sf_dir):
    """Names that stages use themselves do no harm, and such columns come through."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = [c for x in ("score", "label", "key", "id", "copies", "turn", "no_text", "lost", "row", "sha", "rank", "mark") for c in (x, f"{x}_", f"__{x}")] + ["_d", "Size", "component"]
    docs = docs.withColumns({c: F.lit(f"of {c}") for c in odd})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        assert kept.filter(" or ".join(f"`{c}` <> 'of {c}'" for c in odd)).count() == 0 and not kept.isEmpty(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(5), sf_dir).count() == 5


def test_pipeline_run_is_its_stages(spark, sf_dir):
    """What run() returns is what the stages give one after the other, and the same again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(docs)


def whole_texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def detections(words, rules):
    """Every rule's matches, without those that lie within another of at least their priority."""
    line = " " + " ".join(words) + " "
    found = []
    for turn, r in enumerate(rules):
        if r.base or not any(k in line for k in license_scan._needles(r)):
            continue
        for m in re.finditer(rf"(?<= )(?:{r.regex})(?= )", line):
            start = line[: m.start()].count(" ") - 1
            found.append((start, start + len(m[0].split(" ")), r.priority, turn, r.label))
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and b[2] >= a[2] and (b[:3] != a[:3] or b[3] < a[3])
    return [a for a in found if not any(inside(a, b) for b in found if b is not a)]


def test_license_query_equals_brute_force(spark, sf_dir):
    rules = license_scan.default_rules()
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r in queries.queries()["op1_license_scan"](spark, sf_dir).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(whole_texts_cache[r["doc_id"]]))
        base = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in base]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(base), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert r["labels"] == ",".join(sorted({x for _, x in base} | {d[4] for d in detections(words, rules)})), r["doc_id"]


@pytest.fixture(autouse=True)
def _texts(spark, sf_dir):
    if not whole_texts_cache:
        whole_texts_cache.update(whole_texts(spark, sf_dir))


whole_texts_cache: dict = {}


def test_bpe_query_equals_tiktoken(spark, sf_dir):
    ranks, pattern = queries.tokenizer()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    for r in queries.queries()["op5_bpe"](spark, sf_dir).collect():
        text = whole_texts_cache[r["doc_id"]]
        ids = known.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_secret_query_keeps_every_base_span(spark, sf_dir):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in queries.queries()["op9_secret_scan"](spark, sf_dir).collect():
        text = whole_texts_cache[r["doc_id"]]
        kinds = {
            "assign": [m.span() for m in assign.finditer(text) if len(m[2]) >= 6], "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
            "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
        }
        order = sorted((s, k, name, e) for k, (name, spans) in enumerate(kinds.items()) for s, e in spans)
        base = [f"{name}:{s}:{e}" for s, _, name, e in order]
        assert [r[f"n_{k}"] for k in kinds] == [len(x) for x in kinds.values()]
        assert r["base_sha256"] == sha(",".join(base)) and set(base) <= set(r["spans"].split(","))
        assert all(x.startswith("random:") for x in set(r["spans"].split(",")) - set(base) - {""})


def test_predictions_follow_their_scores(spark, sf_dir):
    for r in queries.queries()["op10_quality_mil"](spark, sf_dir).collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    for r in queries.queries()["op8_language_id"](spark, sf_dir).collect():
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(map(str.isalpha, whole_texts_cache[r["doc_id"]])))


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir, tmp_path):
    """Rows with nulls, ties, repeats and families through all stages after the classifier, whose decisions
    are taken as they are."""
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 300, 60)]
    texts = [None, "", "a b", "a b", " ".join(words), " ".join(words[:-1]), " ".join(words[:30] + ["x"] * 20), "short text", *(" ".join(f"t{x}" for x in rng.integers(0, 99, 40)) for _ in range(20))]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[1:3]:
        kept = stage(spark, kept, sf_dir)
    last: dict[str, int] = {}
    for i, t in enumerate(texts):
        last[t or ""] = max(i, last.get(t or "", -1))
    near = {i: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} or ({tuple(x)} if x else set()) for i in last.values() for x in [(texts[i] or "").split()]}
    pairs = [(a, b) for a, b in combinations(sorted(near), 2) if near[a] and 100 * len(near[a] & near[b]) >= 80 * len(near[a] | near[b])]
    lost = {b for _, b in pairs}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(near) - lost)
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, sf_dir)
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert set(taken) <= set(near) - lost and max(taken.values()) <= 2
    ranks, pattern = queries.tokenizer()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    found = corpus_pipeline.STAGES[4][1](spark, mixed, sf_dir).collect()
    assert Counter(r["doc_id"] for r in found) == taken and all(r["ids"] == known.encode_ordinary(texts[r["doc_id"]] or "") for r in found)


def test_pipeline_of_no_documents(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0, name
