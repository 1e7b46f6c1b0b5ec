"""The corpus pipeline against a plain version of its stages, and the driver's contract for the numbered queries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from strandwise.llm import bpe


def text(rng, n):
    return " ".join(f"{rng.choice('alpha beta gamma delta epsilon zeta eta'.split())}{rng.randrange(500)}" for _ in range(n))


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    rows, toxic, copies = [], set(), {}
    for i in range(300):
        body = text(rng, 60)
        if i % 10 == 3:
            body, _ = body + " idiot scum", toxic.add(i)
        if i % 10 == 7:
            copies[i] = i - 1
            body = rows[i - 1][1].split("\n")[1] + (" tail" if i % 20 == 7 else "")
        rows.append((i, "Menu of the site\n" + body, "en", f"s{i % 3}", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append({r.doc_id: r for r in docs.collect()})
    whole = {i: t for i, t, *_ in rows}
    assert set(seen[0]) == set(whole) - toxic
    assert {i: r.text for i, r in seen[1].items()} == {i: whole[i].split("\n")[1] for i in seen[0]} and all(r.n_chars == len(r.text) for r in seen[1].values())
    assert set(seen[2]) == set(seen[1]) - {i for i, c in copies.items() if c in seen[1]}
    it = bpe.coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    for r in got:
        body = seen[2][r.doc_id].text
        ids = it.encode(body).tolist()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(body.encode()).hexdigest())


def test_lines_of_a_hot_source_go(spark):
    """A line and a long passage in 3 and 2 of 100 pages of a source with half of all rows, and a line in 8 of its 1,000 pages
    that is no boilerplate."""
    rng, rows = random.Random(4), []
    line, passage, clean = "Read more in our weekly letter", text(rng, 400), "So it goes"
    for i in range(2000):
        hot, body = i < 1000, [text(rng, 12), text(rng, 12)]
        extra = [line] * (hot and i % 100 < 3) + [passage] * (hot and 50 <= i % 100 < 52) + [clean] * (hot and i % 125 == 99)
        extra += [line] * (i == 1999)
        rows.append((i, "\n".join([body[0], *extra, body[1]]), "en", "hot" if hot else f"s{i % 10}", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    want = {i: "\n".join(x for x in t.split("\n") if i >= 1000 or x not in (line, passage)) for i, t, *_ in rows}
    assert got == want and sum(clean in t for t in got.values()) == 8 and line in got[1999]


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "same words in both of these rows", "en", "a", 1)] * 3 + [(2, "other words in this row of ours", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == [1, 2]


ODD = [
    (0, None, "en", "a", None), (1, "", None, "a", 0), (2, " \n\t ", "en", None, 3), (3, "one", "en", "b", 3), (4, "lorem ipsum dolor " * 20_000, "fr", "b", 1), (5, "same text here", "en", "a", 1),
    (5, "same text here", "en", "a", 1), (None, "no id", None, None, None), (None, None, None, None, None), (6, "É ß 日本 𝒜 ́", "de", "c", 2), (7, "SAME text here", "en", "c", 1),
]
CLASHES = ["score", "predicted", "held_out", "bad", "lines", "left", "th", "copies", "copy", "id", "site", "stays", "n", "ids", "decoded", "column_0"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, tmp_path, stage):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns, and an empty table."""
    spark.createDataFrame([*((i, 0, 0) for i in range(8)), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in ODD], schema + "".join(f", {c} string" for c in CLASHES))
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, docs, str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in got)
    every = Counter(r[0] for r in ODD)
    if name == "minhash_near_dedup":
        assert ids == every - Counter([5]) - Counter([7])
    elif name == "mixing":
        assert set(ids) <= set(every) and ids[None] >= 1 and all(n <= 3 * every[i] for i, n in ids.items())
    else:
        assert ids == every
    if name == "line_dedup":
        assert {r.doc_id: r.text for r in got if r.doc_id is not None} == {r[0]: r[1] for r in ODD if r[0] is not None}
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0


BASE = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    ("access", r"AKIA[A-Z0-9]+", 18, 0), ("hex", r"[0-9a-f]+", 16, 0),
)


def test_queries_as_their_contracts(spark, tmp_path):
    """Columns of the queries over texts, computed anew by plain Python."""
    rng, key = random.Random(2), lambda a, n: "".join(rng.choice(a) for _ in range(n))
    rows = [(i, text(rng, rng.randrange(40)) + f" é token = '{key('abcXYZ0123', rng.randrange(10, 30))}' AKIA{key('ABC0', rng.randrange(12, 18))} {key('0123456789abcdef', rng.randrange(10, 40))} 日", ["en", "fr"][i % 2], f"s{i % 4}", 0) for i in range(120)]
    rows += [(200, None, "en", "s1", 0), (201, "", None, None, 0), (202, "x" * 576, "en", "s0", 0), (203, "12 34", "fr", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: {r.doc_id: r for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    secrets, coded, media, langs, mixed = (run(n) for n in ("op2_secrets", "op5_byte_bpe", "op8_media", "op10_language_id", "op6_mixing"))
    ranks = bpe.coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    total = {}
    for i, t, _, s, _ in rows:
        t = t or ""
        found = sorted((m.start(), k, m.end()) for k, (_, p, n, g) in enumerate(BASE) for m in re.finditer(p, t) if len(m.group(g)) >= n)
        spans = [f"{BASE[k][0]}:{a}:{b}" for a, k, b in found]
        r = secrets[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(n) for x in spans) for n, *_ in BASE)
        assert r.base_sha256 == sha(",".join(spans).encode()) and set(spans) <= set(r.spans.split(",") if spans else spans)
        ids = lib.encode_ordinary(t)
        assert (coded[i].n_tokens, coded[i].ids_sha256, coded[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))
        body = t.encode()
        load = body + b"\xff" * (-len(body) % 576 if body else 576)
        r = media[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (len(body), len(load), sha(load), zlib.crc32(load[-32:]), len(load) + 44)
        assert langs[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and (langs[i].lang_pred == "und") == (not re.search(r"[^\W\d_]", t))
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        total[s] = total.get(s, 0) + n
        assert mixed[i].size == n and mixed[i].taken in (0, n, 2 * n, 3 * n)
    assert all(mixed[i].source_size == total[s] for i, _, _, s, _ in rows) and media[202].payload_bytes == 576


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert [next((q for q in queries if q.startswith(f"op{n}_")), None) is not None for n in range(1, 11)] == [True] * 10
    assert "pipeline" in queries and set(sql) <= set(queries)
