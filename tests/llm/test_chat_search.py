import hashlib
import random

import numpy as np
import pytest

from weftline.llm import chat, search


def test_escaping_round_trip():
    rng = random.Random(0)
    bits = ["\\", "|", "<|", "|>", "<|end|>", "<|user|>", "\\p", "p", "\n", "é🙂", "role:", "<", ">", " a"]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "my|role\\", "end"]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]
    with pytest.raises(ValueError):
        chat.parse("<|user|>a<|end|>b")


def test_token_mask_against_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(100):
        cuts = np.sort(rng.choice(200, 12, replace=False))
        spans = cuts.reshape(-1, 2)
        starts = np.sort(rng.integers(0, 200, 50))
        offsets = np.stack([starts, starts + rng.integers(0, 6, 50)], axis=1)
        want = [any(a < y and x < b for x, y in spans) and b > a for a, b in offsets]
        assert chat.token_mask(offsets, spans).tolist() == want
    assert chat.token_mask(np.zeros((0, 2), int), spans).tolist() == []


def test_formatting(spark):
    rng = random.Random(1)
    rows = [(1, 0, "system", "é🙂ñ |x|"), (1, 1, "user", None), (1, 2, "assistant", "one\n\ntwo  "), (1, 3, None, "?"), (1, 4, "assistant", ""), (2, 0, "assistant", "<|end|>"), (2, 0, "assistant", "<|end|>"), (2, None, "critic", "\\|"), (None, 5, "assistant", "x"), *chat.HARD]
    rows += [(9, i, rng.choice(["user", "assistant"]), " ".join(rng.choice(["naïve", "the", "|", "\n", "日本"]) for _ in range(30))) for i in range(400)]
    talks = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    formatted = chat.format_conversations(talks)
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    by_conv = {}
    for c, turn, role, text in rows:
        by_conv.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(chat.render([t[1:] for t in turns])[0])
    for r in formatted.where("conv_id = 1").collect():
        assert len(r.input_ids) == len(r.token_start) == len(r.loss_mask)
    assert chat.digest(chat.format_conversations(talks.limit(0))).count() == 0


def brute(queries, rows, k):
    out = {}
    for q, code in queries:
        found = sorted((bin((code ^ c) & (2**64 - 1)).count("1"), i) for i, c in set(rows) if c is not None)
        out[q] = found[:k]
    return out


@pytest.mark.parametrize("segments", [None, 4])
def test_search_against_brute_force(spark, segments):
    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centres = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(900):
        c = rng.choice(centres) if i % 3 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randrange(10)):
            c ^= 1 << b
        rows.append((i, signed(c)))
    rows += [(2000 + i, signed(centres[0])) for i in range(400)] + rows[:5] + [(5000, None)]
    queries = [r for r in rows[:900] if r[0] % 60 == 0] + [(7000, signed(rng.getrandbits(64))), (7001, signed(centres[0]))]
    schema = "id long, code long"
    got = {}
    for r in search.top_k(spark.createDataFrame(queries, schema), spark.createDataFrame(rows, schema), 10, segments).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbor_id))
    want = brute(queries, rows, 10)
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == want


def test_search_small_and_empty(spark):
    schema = "id long, code long"
    few = spark.createDataFrame([(1, 0), (2, 7)], schema)
    got = search.top_k(few, few, 5).collect()
    assert sorted((r.query_id, r["rank"], r.neighbor_id, r.distance) for r in got) == [(1, 1, 1, 0), (1, 2, 2, 3), (2, 1, 2, 0), (2, 2, 1, 3)]
    assert search.top_k(few.limit(0), few).count() == 0 and search.top_k(few, few.limit(0)).count() == 0


def test_sign_codes(spark):
    rows = [(1, [0.5, -1.0, float("nan"), 2.0]), (2, None), (3, [1.0] * 63 + [2.0]), (4, [1.0] + [0.0] * 63 + [-2.0, 3.0]), (5, [None, 1.0])]
    got = {r.id: r.code for r in search.sign_codes(spark.createDataFrame(rows, "v long, e array<float>"), "v", "e").collect()}
    assert got == {1: 0b1001, 3: -1, 4: 0b10, 5: 0b10}


@pytest.mark.parametrize("clustered", [False, True])
def test_search_of_many_codes(spark, clustered):
    """50,000 codes: every query ends by its radii; none is compared with all codes."""
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 1 << 64, 50_000, dtype=np.uint64)
    if clustered:
        centres = codes[rng.integers(0, 900, len(codes))]
        flips = rng.random((len(codes), 64)) < 0.06
        codes = centres ^ np.packbits(flips, axis=1, bitorder="little").view("<u8").ravel()
        codes[:20_000] = (codes[:20_000] & ~np.uint64(0xFFFF)) | np.uint64(77)  # a segment value that many codes share
    rows = [(i, int(c)) for i, c in enumerate(codes.view(np.int64).tolist())]
    asked = rows[::500]
    df = spark.createDataFrame(rows, "id long, code long")
    got = {}
    for r in search.top_k(spark.createDataFrame(asked, "id long, code long"), df, 10, shard_codes=3_000).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbor_id))
    ids = np.arange(len(codes))
    for q, _ in asked:
        d = np.bitwise_count(codes ^ codes[q])
        order = np.lexsort((ids, d))[:10]
        assert sorted(got[q]) == [(n + 1, int(d[i]), int(i)) for n, i in enumerate(order)]


def test_search_of_outliers_and_clashing_names(spark):
    """Far queries grow to whole segments; columns of other names are not read, one code may be asked under several ids."""
    rows = [(i, (1 << (i % 7)) - 1) for i in range(60)]
    extra = "id long, code long, query long, distance string, ids int, salt int, bound int"
    table = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], extra)
    asked = spark.createDataFrame([(1, -1, 9, "y", 9, 9, 9), (2, -1, 9, "y", 9, 9, 9), (3, None, 9, "y", 9, 9, 9), (None, 5, 9, "y", 9, 9, 9)], extra)
    got = {}
    for r in search.top_k(asked, table, 12).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbor_id))
    want = brute([(1, -1), (2, -1)], rows, 12)
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == want


def test_probes_by_flips_and_by_values():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 1 << 64, 3000, dtype=np.uint64))
    shard = search.Shard(codes, np.arange(len(codes)), np.ones(len(codes), int), 20, 11)
    own = shard.value_of(rng.integers(0, 1 << 64, 40, dtype=np.uint64))
    for radius in range(13):
        found = [set(), set()]
        for values in (0, 1):
            some = search.Shard(codes[:: 50 if values else 1], np.arange(len(codes[:: 50 if values else 1])), np.ones(len(codes[:: 50 if values else 1]), int), 20, 11)
            for q, v in some.probe(own, radius):
                found[values] |= set(zip(q.tolist(), some.values[v].tolist(), strict=True))
            want = {(q, int(v)) for q in range(40) for v in some.values if int(v ^ own[q]).bit_count() == radius}
            assert found[values] == want
