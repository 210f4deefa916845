"""The pipeline over awkward documents."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .helpers import LONG, documents

EN = "this is the text of a document in the language that most of these documents are in and it has number {}"
FR = "ceci est le texte d'un document dans la langue que peu de ces documents ont et il porte le nombre {}"


def save(spark, tmp_path, rows):
    docs = documents(spark, rows).select(*corpus_pipeline.COLUMNS, "size", "bucket")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def ordinary():
    # Texts far from each other, so that none is a near-duplicate of another.
    rows = [(i, " ".join(f"{w}{i * 7 + k}" if k % 3 == 0 else w for k, w in enumerate((EN.format(i) + " ") .split() * 3)), "en", "a") for i in range(40)]
    return rows + [(100 + i, " ".join(f"{w}{i * 5 + k}" if k % 3 == 0 else w for k, w in enumerate(FR.format(i).split() * 3)), "fr", None) for i in range(20)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, None, None, None)],
        [(1, "", "en", "a"), (2, None, "en", "a"), (3, "   ", None, None)],
    ],
)
def test_documents_without_text_make_nothing(spark, tmp_path, rows):
    assert corpus_pipeline.run(spark, save(spark, tmp_path, rows)).count() == 0


def test_awkward_documents(spark, tmp_path):
    rows = ordinary()
    rows += [rows[3]] * 4 + [(None, EN.format("x") + " mail a.b@c.de", "en", "a")] * 3 + [(None, "le texte sans nombre que cette langue a dans ce document", None, None)]
    rows += [(500, LONG.replace("word", "the text of this document "), "en", "b"), (501, None, "en", "b"), (502, "", None, None)]
    sf_dir = save(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = Counter(r["doc_id"] for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs.withColumn("__key", docs["doc_id"]), sf_dir).select(*corpus_pipeline.COLUMNS).cache()
        ids = Counter(r["doc_id"] for r in docs.collect())
        assert set(ids) <= set(kept), name
        if name == "language_id":
            assert 501 not in ids and 502 not in ids and 500 in ids and ids[3] == 5
        if name == "simhash_near_dedup":
            assert ids[3] == 1 and ids[None] == 2 and ids[500] == 1
        if name == "pii":
            assert not any("a.b@c.de" in r["text"] for r in docs.collect()) and all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        kept = ids
    pieces = corpus_pipeline.pack_sequences(spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == kept
    # What comes out can be trained on: the ids are those that plain tokenizers make of the last texts.
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter()
    for r in pieces:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        got[r["doc_id"], r["piece"], tuple(ids.tolist())] += 1
    joined = defaultdict(list)
    for i, piece, ids in sorted(got, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        joined[i].append((piece, ids))
    for r in docs.collect():
        if r["doc_id"] is not None:
            assert [t for _, ids in joined[r["doc_id"]] for t in ids] == [*plain.encode(r["text"], add_special_tokens=False).ids, 2]
    counts = []
    out = corpus_pipeline.run(spark, sf_dir, counts)
    assert Counter((r["doc_id"], r["piece"], r["length"], bytes(r["ids"])) for r in out.collect()) == Counter((r["doc_id"], r["piece"], r["length"], bytes(r["ids"])) for r in pieces)
    assert [name for name, _ in counts] == ["documents", *[name for name, _ in corpus_pipeline.STAGES]]
    assert counts[0][1] == len(rows) and counts[-1][1] == len(pieces)
