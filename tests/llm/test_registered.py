"""The registered queries on a small folder of tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from odflux.llm.queries import QUERIES
from odflux.llm.tokens import encoder

TEXTS = [f"Document {k} has some words, and {'more ' * k}of them.\nSecond line {k % 3}." for k in range(24)] + [None, "", "a b c"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")

    write("documents", [(7 * k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(TEXTS)],
          "doc_id long, text string, lang string, source string, n_chars long")
    write("embeddings", [(k, [(k * j % 17) / 17 for j in range(32)], k % 3) for k in range(90)], "vec_id long, embedding array<float>, label int")
    write("pages", [(k, f"u{k}", f"<body><nav>x</nav><article><p>{'Words of page. ' * 20}{k % 5}</p></article>") for k in range(20)] + [(20, "u", None)],
          "page_id long, url string, html string")
    write("benchmark", [(k, f"words of them {k}") for k in range(5)], "item_id long, text string")
    write("conversations", [(c, t, "user" if t % 2 == 0 else "assistant", f"say {c} {t}") for c in range(4) for t in range(4)],
          "conv_id long, turn int, role string, text string")
    return path


def run(spark, folder, prefix):
    (name,) = [q for q in QUERIES if q.startswith(prefix + "_")]
    return QUERIES[name](spark, folder).collect()


def test_fingerprints(spark, folder):
    rows = {r.doc_id: r for r in run(spark, folder, "op1")}
    assert len(rows) == len(TEXTS) and all(len(r.fingerprint) == 16 for r in rows.values())
    assert rows[24 * 7].fingerprint == rows[25 * 7].fingerprint == "0" * 16
    assert rows[24 * 7].component_id == rows[25 * 7].component_id == 24 * 7


def test_neighbours(spark, folder):
    rows = run(spark, folder, "op2")
    assert {(r.query_id, r.rank) for r in rows} == {(q, k) for q in (0, 50) for k in range(1, 6)}


def test_pages(spark, folder):
    rows = {r.page_id: r for r in run(spark, folder, "op3")}
    assert rows[3].text == ("Words of page. " * 20 + "3") and rows[20].text == "" and rows[20].n_chars == 0


def test_store(spark, folder):
    tok, start = encoder(), 0
    for row, text in zip(sorted(run(spark, folder, "op4"), key=lambda r: r.doc_id), TEXTS, strict=True):
        ids = np.append(np.frombuffer(tok.encode(text or ""), tok.kind), 0).astype("<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_mix(spark, folder):
    rows = run(spark, folder, "op5")
    assert len(rows) == len(TEXTS) and all(0 <= r.taken <= 2 * r.size for r in rows)


def test_passages(spark, folder):
    rows = {r.doc_id: r for r in run(spark, folder, "op6")}
    assert rows[24 * 7].kept_sha256 == hashlib.sha256(b"").hexdigest() and len(rows) == len(TEXTS)


def test_quality(spark, folder):
    rows = {r.doc_id: r for r in run(spark, folder, "op7")}
    assert rows[24 * 7].base_failed and not rows[24 * 7].kept and len(rows) == len(TEXTS)


def test_packing(spark, folder):
    tok = encoder()
    held = {}
    for r in run(spark, folder, "op8"):
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
    assert held == {7 * k: len(tok.encode(t or "")) // tok.kind.itemsize + 1 for k, t in enumerate(TEXTS)}


def test_chat(spark, folder):
    rows = {r.conv_id: r for r in run(spark, folder, "op9")}
    odd = "<|im_end|><|im_start|>assistant ok"
    assert set(rows) == {-1, 0, 1, 2, 3}
    assert (rows[-1].n_turns, rows[-1].loss_chars) == (2, len(odd))
    assert rows[-1].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest()
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()
    assert rows[2].loss_chars == len("say 2 1say 2 3")


def test_shards(spark, folder):
    rows = run(spark, folder, "op10")
    assert len(rows) == len(TEXTS) and all(0 <= r.shard < 16 for r in rows)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_codes(spark, folder):
    rows = run(spark, folder, "op11")
    assert len(rows) == 90 and {len(r.code) for r in rows} == {32} and len({r.codebooks_sha256 for r in rows}) == 1


def test_archives(spark, folder):
    rows = {r.page_id: r for r in run(spark, folder, "op12")}
    assert len(rows) == 21 and rows[7].record_type == "revisit" and rows[7].refers_to == 2 and rows[20].payload_bytes == 0
    assert rows[7].payload_digest == rows[2].payload_digest and rows[7].payload_bytes == rows[2].payload_bytes > 100


def test_search(spark, folder):
    rows = run(spark, folder, "op13")
    assert {r.item_id for r in rows} == set(range(5)) and all(r.score > 0 for r in rows)
    assert spark.createDataFrame(rows).groupBy("item_id").agg(F.max("rank").alias("k")).where("k > 10").count() == 0
