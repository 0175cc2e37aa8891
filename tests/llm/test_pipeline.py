"""The pipeline's stages against plain versions, each on what the stage before really kept."""

import hashlib
import random
import tempfile

import pytest
from test_bpe_tree import PATH
from test_decontam import brute as decontam_brute
from test_line_dedup import brute as lines_brute
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline
from quillwork.llm.bpe_tree import read_ranks

COMMON = "the of and to in is that was on for".split()


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(21)

    def word():
        return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))

    def text(lines):
        return "\n".join(" ".join(rng.choice(COMMON) if rng.random() < 0.4 else word() for _ in range(30)) for _ in range(lines))

    bench = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    docs = [(i, text(rng.randint(3, 6)), "en", "s", 1) for i in range(30)]
    docs += [(100 + i, docs[i][1], "en", "s", 1) for i in range(3)]  # exact copies
    docs += [(110 + i, docs[5 + i][1] + "\n" + text(2), "en", "s", 1) for i in range(3)]  # copies with more
    docs += [(120 + i, text(3) + " " + bench[i][1], "en", "s", 1) for i in range(3)]  # benchmark passages
    docs += [(130, None, "en", "s", 1), (131, "", "en", None, 1), (132, "too short", None, "s", 1), (133, "x " * 400, "en", "s", 1)]
    path = tempfile.mkdtemp()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, bench


def test_stages(spark, folder):
    import tiktoken
    import public_tokenizers

    path, bench = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        assert name and (k == 4 or out.columns == columns)
        out.write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        seen.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    quality, lines, near, clean, last = seen
    assert {130, 131, 132, 133}.isdisjoint(quality) and {0, 29, 100, 110, 120} <= set(quality)
    want = {i: t for i, t in lines_brute([(i, r["text"]) for i, r in quality.items()]).items() if t.strip()}
    assert {i: r["text"] for i, r in lines.items()} == want
    assert {100, 101, 102}.isdisjoint(lines) and all(r["n_chars"] == len(r["text"]) for r in lines.values())
    groups = brute_components([(i, brute_fingerprint(r["text"])) for i, r in lines.items()])
    assert set(near) == set(groups.values())
    hit = {i for i, _, n, _ in decontam_brute([(i, r["text"]) for i, r in near.items()], bench) if n}
    assert {120, 121, 122} <= hit and set(clean) == set(near) - hit
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    assert set(last) == set(clean)
    for i, r in last.items():
        ids = own.encode_ordinary(clean[i]["text"])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(clean[i]["text"].encode()).hexdigest()
    run = corpus_pipeline.run(spark, path)
    assert {r["doc_id"]: r["ids_sha256"] for r in run.collect()} == {i: r["ids_sha256"] for i, r in last.items()}
