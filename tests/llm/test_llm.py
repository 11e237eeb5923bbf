"""Training-data operators against brute-force versions on small tables, with nulls, blanks, ties, repeats and clashing names."""

import collections
import fractions
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from meshquill.llm import collocations, components, decontamination, line_dedup, media, mixing, ngram_join, packing, periodic_runs, pii, quality, sharding, toxicity, vectors  # noqa: E402
from meshquill.llm import queries as llm  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, key string"


def docs(spark, texts, sources=None):
    rows = [(k, t, "en", (sources or {}).get(k, f"s{k % 4}"), 0, -1, -1.0, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = ["", None, " \n\t", "one", "one two", "a b c d e f g h", "a b c d e f g h", "A B C D E F G H", "x " * 5000, "é ü 漢字 \U0001F600 end", "l1 is a line of words\nl2"]


@pytest.fixture(scope="module")
def odd(spark):
    base = docs(spark, ODD, {0: None, 3: "", 5: "s\U0001F600"})
    return base.unionAll(base.where("doc_id in (5, 8)")).unionAll(base.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long"))).cache()


def empty(df):
    return df.where("false")


# ---- mixing
def test_mixing_targets_and_copies(spark, odd):
    rows = mixing.mix(odd, rows_per_bucket=2).collect()
    assert len(rows) == odd.count() and {"lang", "key"} <= set(rows[0].asDict())
    size = collections.Counter()
    for r in rows:
        assert r["mq_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["mq_copies"] <= 3
        size[r["source"]] += r["mq_size"]
    left, total, target = sorted(size, key=lambda s: (s is None, s)), sum(size.values()), {}
    weight = {s: 1 + k % 3 for k, s in enumerate(left)}
    while True:  # cap, share again, until none is above
        level = (total - sum(target.values())) / max(sum(weight[s] for s in left), 1e-9)
        over = [s for s in left if level * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left.remove(s)
    target |= {s: level * weight[s] for s in left}
    assert {r["source"]: round(r["target"], 6) for r in rows} == {s: round(t, 6) for s, t in target.items()}
    again = mixing.mix(odd, rows_per_bucket=10**9).collect()
    key = lambda rs: sorted((str(r["doc_id"]), str(r["text"]), r["mq_copies"]) for r in rs)
    assert key(rows) == key(again)
    assert mixing.mix(empty(odd)).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_mixing_comes_near_its_targets(spark):
    got = mixing.op1(spark, SF).groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r["t"] - r["target"]) <= 3 * r["m"] for r in got)


# ---- sharding
def test_matrix_and_sampler():
    m = sharding.communication_matrix([100, 0, 7, 50], 8, 3)
    assert m.sum(axis=1).tolist() == [100, 0, 7, 50] and m.min() >= 0 and np.ptp(m.sum(axis=0)) <= 1
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert 0 <= sharding.hypergeometric(rng, 10**11, 7 * 10**11, 10**9) <= 10**9


def test_sharding_slots(spark, odd):
    keyed = odd.withColumn("h", F.xxhash64("text"))
    rows = sharding.shard(keyed, ["doc_id", "h"], rows_per_partition=3).collect()
    assert len(rows) == odd.count()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["mq_shard"]].append(r["mq_slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(s, [])) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert sharding.shard(empty(keyed), ["doc_id", "h"]).count() == 0


# ---- media
def foreign_frame(rng, width, height, sampling, restart, usual=False):
    """A JPEG frame by an encoder of the tests' own: usual code lengths, runs, end-of-block, differences; with the luma blocks it holds."""
    zigzag = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8, i % 8)[(i // 8 + i % 8) % 2 == 0], i))
    zigzag = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    assert zigzag == media.ZIGZAG
    symbols = {"dc": list(range(12)), "ac": [0, 240, *(r << 4 | s for s in range(1, 9) for r in range(16))]}
    codes, tables = {}, {}
    for name, members in symbols.items():
        lengths = [0] * 16
        widths = [3] * 2 + [5] * 10 if name == "dc" else [2] + [4] * 5 + [9] * (len(members) - 6)
        code, last = 0, widths[0]
        for s, w in zip(members, widths):
            code <<= w - last
            codes[name, s], last = (code, w), w
            code += 1
            lengths[w - 1] += 1
        tables[name] = bytes(lengths) + bytes(members)
    if usual:  # no DHT: codes of the format's annex, all parts by the tables of brightness
        told = media.usual_tables()
        codes = {(name, s): (int(code_of(told[k], s), 2), len(code_of(told[k], s))) for name, k in (("dc", 0), ("ac", 16)) for s in told[k][16:]}
    parts = [(1, sampling, 0)] + ([(2, (1, 1), 1), (3, (1, 1), 1)] if sampling else [])
    h, v = sampling or (1, 1)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    bits, scan, luma, before = [], [], np.zeros((down, across, v, h, 64), int), {}

    def put(value, n):
        bits.extend(value >> (n - 1 - i) & 1 for i in range(n))

    def close(marker=b""):
        bits.extend([1] * (-len(bits) % 8))
        scan.append(np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00") + marker)
        bits.clear()

    def signed(x):
        n = int(abs(x)).bit_length()
        return n, (x if x > 0 else x + (1 << n) - 1)

    for u in range(across * down):
        if restart and u and u % restart == 0:
            close(bytes([0xFF, 0xD0 + (u // restart - 1) % 8]))
            before = {}
        for c, factors, _ in parts:
            for b in range((factors or (1, 1))[0] * (factors or (1, 1))[1]):
                block = np.where(rng.random(64) < 0.1, rng.integers(-200, 201, 64), 0)
                block[0] = rng.integers(-60, 61)
                n, extra = signed(int(block[0]) - before.get(c, 0))
                before[c] = int(block[0])
                put(*codes["dc", n]), put(extra, n)
                run = 0
                for x in block[1:]:
                    if x == 0:
                        run += 1
                        continue
                    while run > 15:
                        put(*codes["ac", 240])
                        run -= 16
                    n, extra = signed(int(x))
                    put(*codes["ac", run << 4 | n]), put(extra, n)
                    run = 0
                if run:
                    put(*codes["ac", 0])
                if c == 1:
                    luma[u // across, u % across, b // h, b % h] = block
    close()
    quant = bytes(range(1, 65))
    segment = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    sof = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)])
    sof += b"".join(bytes([c, f[0] << 4 | f[1] if f else 0x11, t]) for c, f, t in parts)
    head = segment(0xE0, b"JFIF\0") + segment(0xDB, b"\0" + quant + (b"\1" + quant)) + segment(0xC0, sof) + (b"" if usual else segment(0xC4, b"\0" + tables["dc"] + b"\x10" + tables["ac"]))
    head += segment(0xDD, restart.to_bytes(2, "big")) if restart else b""
    sos = bytes([len(parts)]) + b"".join(bytes([c, 0]) for c, _, _ in parts) + b"\0\x3f\0"
    basis = np.array([[(0.5**0.5 if k == 0 else 1) * np.cos((2 * x + 1) * k * np.pi / 16) / 2 for x in range(8)] for k in range(8)])
    picture = np.zeros((down * v * 8, across * h * 8))
    for (y, x, b, a), _ in np.ndenumerate(luma[..., 0]):
        full = np.zeros(64)
        full[zigzag] = luma[y, x, b, a] * np.arange(1, 65)
        picture[(y * v + b) * 8 : (y * v + b + 1) * 8, (x * h + a) * 8 : (x * h + a + 1) * 8] = basis.T @ full.reshape(8, 8) @ basis + 128
    return b"\xff\xd8" + head + segment(0xDA, sos) + b"".join(scan) + b"\xff\xd9", np.clip(np.round(picture[:height, :width]), 0, 255)


@pytest.mark.parametrize(("width", "height", "sampling", "restart"), [(24, 16, None, 0), (37, 21, (2, 2), 0), (40, 24, (2, 1), 2), (8, 8, (1, 1), 1)])
def test_foreign_streams(spark, width, height, sampling, restart):
    rng = np.random.default_rng(width)
    made = [foreign_frame(rng, width, height, sampling, restart) for _ in range(3)]
    got = media.decoded([j for j, _ in made] + [made[0][0][:-9], b"junk"])
    for (_, want), (_, pixels) in zip(made, got):
        assert pixels.shape == want.shape and np.abs(pixels.astype(int) - want).max() <= 1
    assert isinstance(got[4], ValueError)
    chunk = media._chunk
    avi = chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", j) for j, _ in made)))  # no index, no header
    rows = media.to_clips(spark.createDataFrame([(1, bytearray(avi)), (2, bytearray(b"no media")), (3, None), (4, bytearray(media.encode(b"x" * 64)))], "doc_id long, media binary")).collect()
    assert {r["doc_id"] for r in rows if r["error"]} == {2} and sum(r["frames"] for r in rows if r["doc_id"] == 1) == 3 and 3 not in {r["doc_id"] for r in rows}


def code_of(table, symbol):
    """The code of a symbol, as text, by the canonical rule."""
    code, at = 0, 16
    for n in range(16):
        for s in table[at : at + table[n]]:
            if s == symbol:
                return f"{code:0{n + 1}b}"
            code += 1
        at += table[n]
        code <<= 1
    raise KeyError(symbol)


def test_usual_tables_are_those_of_the_format():
    t = media.usual_tables()
    assert [len(t[k]) for k in (0, 1, 16, 17)] == [28, 28, 178, 178] and all(sum(x[:16]) == len(x) - 16 == len(set(x[16:])) for x in t.values())
    known = {(0, 0): "00", (0, 5): "110", (0, 11): "111111110", (1, 0): "00", (1, 11): "11111111110", (16, 0): "1010", (16, 1): "00", (16, 0xF0): "11111111001", (16, 0x0A): "1111111110000011",
             (16, 0x11): "1100", (16, 0xFA): "1111111111111110", (17, 0): "00", (17, 1): "01", (17, 0xF0): "1111111010", (17, 0x11): "1011", (17, 0xFA): "1111111111111110"}
    assert {k: code_of(t[k[0]], k[1]) for k in known} == known


def test_frames_without_tables_and_further_parts(spark):
    rng = np.random.default_rng(4)
    made = [foreign_frame(rng, 24, 16, (2, 1), 0, usual=True) for _ in range(4)]
    assert all(b"\xff\xc4" not in j[:400] for j, _ in made)
    chunk = media._chunk
    part = lambda kind, js: chunk(b"RIFF", kind + chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", j) for j in js)))
    avi = part(b"AVI ", [j for j, _ in made[:2]]) + part(b"AVIX", [j for j, _ in made[2:3]]) + part(b"AVIX", [j for j, _ in made[3:]])
    found, _ = media.frames(avi)
    assert len(found) == 4
    for (_, want), (_, pixels) in zip(made, media.decoded(found)):
        assert np.abs(pixels.astype(int) - want).max() <= 1
    stored = media.encode(b"y" * 5000)
    assert len(media.frames(stored + part(b"AVIX", [made[0][0]]))[0]) == len(media.frames(stored)[0]) + 1  # the first part by its index


def test_media_clips_of_every_document(spark):
    got = media.media_clips(spark, SF)
    rows = got.groupBy("doc_id").agg(F.sum("frames").alias("n"), F.min("start_s").alias("a"), F.max("error").alias("e")).collect()
    want = {r["doc_id"]: -(-max(64, -(-len((r["text"] or "").encode()) // 64) * 64) // media.PER_FRAME) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n"] for r in rows} == want and all(r["a"] == 0.0 and r["e"] is None for r in rows)


def test_media_round_trip_and_cuts(spark, odd):
    rng = np.random.default_rng(0)
    for n in (64, 1008, 1024, 5000):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert media.decode(media.encode(payload))[0] == payload
    dark, bright = b"\x7f" * 1008 * 6, bytes(rng.integers(0, 256, 1008 * 6, dtype=np.uint8))
    assert [c[0::3] for c in media.clips(media.encode(dark + bright))] == [(0, 6), (1, 6)]
    clips = media.to_clips(media.to_media(odd)).collect()
    assert {c["doc_id"] for c in clips} == {r["doc_id"] for r in odd.collect()} and all(c["end_s"] > c["start_s"] for c in clips)
    rows = odd.select("doc_id", "text").mapInArrow(media._digests, media.DIGEST).collect()
    for r in rows:
        raw = (ODD[r["doc_id"]] if r["doc_id"] is not None else ODD[6]) or ""
        padded, n = media.pad(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert empty(odd).select("doc_id", "text").mapInArrow(media._digests, media.DIGEST).count() == 0 and media.to_clips(media.to_media(empty(odd))).count() == 0
    with pytest.raises(ValueError):
        media.frames(b"no media")


# ---- packing
def test_packing_is_exact_and_tight(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = docs(spark, ["a <|endoftext|> b", *[r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:60]])
    for table in (odd, special):
        rows = packing.packed(table).collect()
        ids = {(r["doc_id"], r["text"]): [*full.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in table.collect()}
        by_doc = {i: v for (i, _), v in ids.items()}
        bins = collections.defaultdict(list)
        for r in rows:
            piece = by_doc[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(piece) == r["length"] <= 2048 and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for b in bins.values():
            end = 0
            for offset, length in sorted(b):
                assert offset == end
                end += length
            assert end <= 2048
        assert sum(r["length"] for r in rows) == sum(len(by_doc[r["doc_id"]]) for r in table.select("doc_id").collect())
    assert packing.packed(empty(odd)).count() == 0


def test_plan_near_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, rng.lognormal(6.3, 0.8, 20000).astype(int) + 1)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    found, held = packing.plan(histogram), collections.Counter()
    for pattern, times in found:
        assert sum(n * c for n, c in pattern.items()) <= 2048
        for n, c in pattern.items():
            held[n] += c * times
    assert held == histogram and sum(t for _, t in found) <= 1.005 * -(-lengths.sum() // 2048)


# ---- quality
def brute_perplexity(trusted, text):
    """Interpolated modified Kneser-Ney over 4-grams of UTF-16 units, with dictionaries."""
    def units(t):
        raw = t.encode("utf-16-le")
        return [0, 0, 0, *(raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)), 0]

    orders = {4: collections.Counter(tuple(u[i : i + 4]) for t in trusted for u in [units(t)] for i in range(len(u) - 3))}
    for k in (3, 2, 1):
        orders[k] = collections.Counter(g[1:] for g in orders[k + 1])
    cut = {k: quality.discounts([sum(n == c for n in o.values()) for c in range(1, 5)]) for k, o in orders.items()}

    def p(g):
        if not g:
            return 1 / 65536
        o, d = orders[len(g)], cut[len(g)]
        mates = [(x, n) for x, n in o.items() if x[:-1] == g[:-1]]
        if not mates:
            return p(g[1:])
        total = sum(n for _, n in mates)
        n = o.get(g, 0)
        return (n - d[min(n, 3)]) / total + sum(d[min(m, 3)] for _, m in mates) / total * p(g[1:])

    u = units(text)
    return float(np.exp(-np.mean([np.log(p(tuple(u[i : i + 4]))) for i in range(len(u) - 3)])))


@pytest.mark.parametrize(("block", "parts"), [(1 << 24, "8"), (40, "3")])
def test_perplexity_against_brute_force(spark, block, parts):
    trusted = ["the cat sat on the mat", "a cat and a hat", "The End.", "кот сидит на ковре", "漢字 \U0001F600 漢字"]
    texts = [*trusted, "the hat", "THE CAT", "zqx#zq", "кот на кот", "漢漢", "\U0001F601", "a", "", None, "the hat"]
    table = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").select("doc_id", "lang", "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        model = quality.counted(table.where(F.col("doc_id") < len(trusted)).select("text"), quality.Scratch())
        got = {r["doc_id"]: r for r in quality.perplexities(table, *model, block).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert abs(got[k]["perplexity"] / (brute_perplexity(trusted, t) if t else 65536) - 1) < 1e-4 and got[k]["filled"] == bool(t)


def test_kneser_ney_sums_to_one():
    n = collections.Counter(g for t in ("the cat sat on the mat", "a cat and a hat", "The End.") for g in quality.grams(t).tolist() if g >> 16 & 0xFFFF == ord("a"))
    keys = np.array(sorted(n), np.uint64)
    d = [np.array([0, 0.5, 0.8, 1.0])] * 4
    model = quality.shard_model(keys, np.array([n[k] for k in keys.tolist()]), d)
    lowest = quality.lowest_order([(97, 3), (98, 1)], d[0])
    for context in ([0, 99, 97], [1, 2, 97]):
        asked = np.arange(65536, dtype=np.uint64) | np.uint64(context[0] << 48 | context[1] << 32 | context[2] << 16)
        assert abs(np.exp(quality.log_probabilities(model, lowest, asked)).sum() - 1) < 1e-9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quality_rejects_junk(spark, sf):
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    good = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").join(labels, "doc_id")
    got = quality.quality(good, labels).join(good.select("doc_id", "quality"), "doc_id").collect()
    junk, fine = ([r["kept"] for r in got if r["quality"] == q] for q in (0, 1))
    assert sum(junk) <= 0.08 * len(junk) and sum(fine) >= 0.98 * len(fine)


def test_quality_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.quality(odd, none).collect()
    assert len(rows) == odd.count() and all(r["kept"] == bool((ODD[6] if r["doc_id"] is None else ODD[r["doc_id"]])) for r in rows)
    some = spark.createDataFrame([(5, 1), (5, 1), (None, 1), (10, 0)], "doc_id long, quality int")
    assert quality.quality(odd, some).count() == odd.count() and quality.quality(empty(odd), some).count() == 0


# ---- n-gram join
def brute(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + min(width, len(w))]) for k in range(max(1, len(w) - width + 1))} if w else set())
    comp = list(range(len(texts)))

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 70)])
def test_jaccard_against_brute_force(spark, width, percent):
    rng = np.random.default_rng(width)
    texts = list(ODD)
    for length in (7, 11, 14, 22, 30, 60, 150):
        for _ in range(3):
            base = [f"w{rng.integers(400)}" for _ in range(length)]
            texts.append(" ".join(base))
            for _ in range(6):
                w = list(base)
                for _ in range(rng.integers(1, 4)):
                    k = rng.integers(len(w))
                    w[k : k + 1] = [] if rng.random() < 0.4 else [f"w{rng.integers(400)}"]
                texts.append(" ".join(w))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(spark, texts), width, percent).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, width, percent)


def test_jaccard_edges(spark, odd):
    rows = ngram_join.jaccard_components(odd).collect()
    assert len(rows) == odd.count() and all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert ngram_join.jaccard_components(empty(odd)).count() == 0
    assert {5, 8} <= {r["doc_id"] for r in ngram_join.near_duplicates_removed(odd).collect()}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 340)] + [(None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in parent}


@pytest.mark.parametrize("path", [(1, 4, 3, 5, 2), (2, 3, 4, 5, 1), (5, 2, 6, 4, 3, 1), (4, 3, 1, 5, 6, 7, 2), (3, 8, 1, 7, 5, 4, 2, 6)])
def test_components_of_one_path(spark, path):
    df = spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")
    assert sorted((r["node"], r["component"]) for r in components.components(df).collect()) == [(n, 1) for n in sorted(path)]


# ---- PII
def luhn(d):
    values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def base_spans(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii_base_spans(spark):
    texts = [*ODD, "a@b.com@c.org x@y", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "+1 (229) 555-4838 +44-20 7946 0958)", "éé joe@x.y.z, 00001.2.3.255 1.2.3.256", "a@b.c_x@d.com", "x" * 50000, "1" * 50000, "a.b@" + "c." * 3000 + "d", "+1((((2", "4111111111111111 5"]
    got = {r["doc_id"]: r for r in pii.pii(docs(spark, texts)).select("doc_id", pii.joined(F.col("base")).alias("b")).collect()}
    assert [got[k]["b"] for k in range(len(texts))] == [base_spans(t or "") for t in texts]
    assert pii.pii(docs(spark, texts).where("false")).count() == 0


def test_pii_spans_of_many_matches(spark):
    """Positions come in pieces, so a text with many matches costs little; each is found."""
    import time

    text = "a@b.co 10.0.0.1 +1 (229) 555-4838 " * 6000
    table = docs(spark, [text, "x"]).repartition(1).cache()
    columns = [F.size(c) for c in pii.base_spans(F.col("text")).values()]
    table.where("doc_id = 1").select(*columns).collect()
    began = time.time()
    row = table.where("doc_id = 0").select(*columns).first()
    assert [row[0], row[1], row[3]] == [6000] * 3 and time.time() - began < 20
    got = pii.pii(table).select("doc_id", pii.joined(F.col("base")).alias("b")).where("doc_id = 0").first()["b"]
    assert got == base_spans(text)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 17, 100])
def test_running(spark, n):
    values = [(7 * k) % 11 for k in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    row = df.select(pii.running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), pii.running(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(3)).alias("m")).first()
    assert row["s"] == np.cumsum(values).tolist() and row["m"] == [max([3, *values[: k + 1]]) for k in range(n)]


def test_pii_thresholds():
    rng = np.random.default_rng(3)
    rows = [(g, int(c), float(y), int(n)) for g in (0, 1) for c in range(0, 101, 7) for n in [rng.integers(1, 30)] for y in [rng.binomial(n, c / 100)]]
    want = {}
    for g in (0, 1):
        cents = sorted(r[1] for r in rows if r[0] == g)
        for c in cents:  # the lowest one that reaches the precision
            s = [(y, n) for h, d, y, n in rows if h == g and d >= c]
            yes, n = sum(y for y, _ in s), sum(n for _, n in s)
            if yes >= 0.9 * n:
                want[g] = max((c + max([0, *(x for x in cents if x < c)])) / 200, 0.5 if yes + 1 >= 0.9 * (n + 2) else 0.9)
                break
    assert pii.lowest_thresholds([("few", 70, 3, 3), ("few", 40, 0, 5), ("many", 70, 30, 30), ("many", 40, 0, 50)], 0.9) == {"few": 0.9, "many": 0.55}
    assert pii.lowest_thresholds(rows, 0.9) == want and pii.lowest_thresholds([]) == {}


def test_trees_add_what_patterns_miss(spark):
    """Among the rows of sf0.1: hidden addresses, and a telephone without a plus are added; other numbers and words are not."""
    hidden = {-1: ("call (614) 555-8001 soon", "phone", "(614) 555-8001"), -2: ("write to joe.smith42 (at) mail8.example (dot) com now", "email", "joe.smith42 (at) mail8.example (dot) com"),
              -3: ("write to joe.smith42 at mail8 dot example dot com", "email", "joe.smith42 at mail8 dot example dot com")}
    rows = [(k, t) for k, (t, _, _) in hidden.items()] + [(-1, hidden[-1][0]), (-5, None), (-6, "look at home"), (-7, "the year 2024 and 8.15 of 12"), (-8, "number 8490294829394200 of it")]
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    table = table.unionAll(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("base", F.lit(0))
    got = collections.Counter((r["doc_id"], r["kind"], r["s"], r["e"]) for r in pii.redact(table).where("doc_id < 0").collect())
    assert got == {(k, kind, t.index(m), t.index(m) + len(m)): 2 if k == -1 else 1 for k, (t, kind, m) in hidden.items()}


# ---- line dedup
def test_lines(spark):
    a = "the quick brown fox jumps over the lazy dog today"
    texts = [f"{a}\nown words of the first document are here now", f"x\n{a}", a, None, "", f"user 17 logged in from host 4 at noon\n{a}", "user 23 logged in from host 9 at noon\nshort line", "own line that comes twice in one text\nown line that comes twice in one text",
             "server alpha restarted the main worker process without any problem at all", "server alpha restarted the spare worker process without any problem at all"]
    got = {r["doc_id"]: r for r in line_dedup.without_lines(docs(spark, texts)).collect()}
    assert [got[k]["mq_dropped"] for k in range(len(texts))] == [0, 1, 1, 0, 0, 1, 1, 0, 0, 1]
    assert got[1]["text"] == "x" and got[2]["text"] == "" and got[3]["text"] is None and got[6]["text"] == "short line" and got[0]["text"] == texts[0]
    assert set(got[0].asDict()) == {*SCHEMA.replace(" string", "").replace(" long", "").replace(" double", "").split(", "), "mq_dropped"}
    assert line_dedup.without_lines(docs(spark, texts).where("false")).count() == 0
    twice = docs(spark, texts).where("doc_id = 0")
    assert all(r["mq_dropped"] == 0 for r in line_dedup.without_lines(twice.unionAll(twice)).collect())


def brute_lines(rows, least=6, leading=3, likeness=0.8):
    """row number -> numbers of the lines dropped, by all pairs of forms; rows: (id, text)."""
    seen, forms = {}, collections.defaultdict(list)
    for at, (i, text) in enumerate(rows):
        if text is None or (i, text) in seen:
            seen.setdefault((i, text), []).append(at)
            continue
        seen[i, text] = [at]
        for k, line in enumerate(text.split("\n")):
            raw = [t for t in re.split(r"[\x20\x09-\x0D]+", line) if t]
            if raw:
                tokens = tuple(raw) if len(raw) < least else tuple("<*>" if re.search("[0-9]", t) else t for t in raw)
                forms[len(raw), tokens].append((i, k, (i, text)))
    leaves = collections.defaultdict(list)
    for n, tokens in forms:
        leaves[(n, tokens) if n < least else (n, tokens[:leading])].append((n, tokens))
    group = {}
    for leaf, members in leaves.items():
        n = members[0][0]
        constant = {}
        if len(members) > 1:
            for place in range(n):
                told = collections.Counter(t[place] for _, t in members)
                have = max(told.values())
                if have >= 2 and have * 2 >= len(members):
                    hashed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t, seed=42)).astype(np.int64))
                    constant[place] = {max((t for t, c in told.items() if c == have), key=hashed)}  # of a tie the larger hash
        like = [m for m in members if sum(m[1][p] in v for p, v in constant.items()) >= n * likeness]
        parent = {m: (like[0] if m in like else m) for m in members}

        def root(m, parent=parent):
            while parent[m] != m:
                m = parent[m]
            return m

        for x in members:
            for y in members:
                if x != y and sum(p == q for p, q in zip(x[1], y[1])) >= n * likeness - 1e-9:
                    parent[root(x)] = root(y)
        group |= {m: root(m) for m in members}
    templates = collections.defaultdict(list)
    for m, lines_ in forms.items():
        templates[group[m]] += lines_
    dropped = collections.defaultdict(set)
    for lines_ in templates.values():
        if len({i for i, _, _ in lines_}) > 1:
            first = min(i for i, _, _ in lines_)
            kept = min((i, k) for i, k, _ in lines_ if i == first)
            for i, k, doc in lines_:
                if (i, k) != kept:
                    for at in seen[doc]:
                        dropped[at].add(k)
    return dropped


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"w{chr(97 + k)}" for k in range(26)]
    pick = lambda n: [words[k] for k in rng.integers(0, 26, n)]
    shared = [pick(n) for n in (2, 4, 7, 9, 9, 14, 30)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.integers(0, 7)):
            line = list(shared[rng.integers(len(shared))]) if rng.random() < 0.6 else pick(rng.integers(1, 12))
            if rng.random() < 0.5 and len(line) > 6:
                line[rng.integers(4, len(line))] = words[rng.integers(26)] if rng.random() < 0.7 else str(rng.integers(100))
            text.append(("  " if rng.random() < 0.2 else "") + " ".join(line))
        rows.append((i, "\n".join(text)))
    rows += [rows[5], rows[9], (100, None), (101, ""), (102, " \n\n"), (103, "\n".join(" ".join(pick(8)) for _ in range(3000)))]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, line int")
    want = brute_lines(rows)
    expect = collections.Counter()
    for at, (i, t) in enumerate(rows):
        expect[i, t if t is None or at not in want else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[at]), len(want.get(at, ()))] += 1
    got = collections.Counter((r["doc_id"], r["text"], r["mq_dropped"]) for r in line_dedup.without_lines(table).collect())
    assert got == expect


def test_lines_short_and_mixed_leaves(spark):
    shared = ["the old server {} the main worker process without any problem now", "the old server {} seven green bottles hanging on some garden wall", "the old server {} nothing of what other people had asked before"]
    texts = [line.format(word) for word in ("restarted", "stopped") for line in shared]  # one leaf, no token in half of it
    texts += ["All rights reserved.\n\nversion 3", "All  rights reserved.\n\nversion 4", "All rights reserved.\n\nversion 3"]
    texts += ["we have a plan to move one two", "we have a plan to move six two", "we have a plan of some other kind", "we have a talk to hold on Monday"]
    got = {r["doc_id"]: r["mq_dropped"] for r in line_dedup.without_lines(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == [0, 0, 0, 1, 1, 1, 0, 1, 2, 0, 1, 0, 0]
    left = corpus_pipeline.line_dedup(spark, docs(spark, texts), SF)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {3, 4, 5, 8, 10}


# ---- toxicity
def model_of(text):
    n, size = toxicity.counted([toxicity.codes(f" {text} ")]) + 1e-3, toxicity.CLASSES
    n = n.reshape(size, size, size)
    return np.log(n / n.sum(axis=2, keepdims=True))


def test_deobfuscation():
    model = model_of("the idiot is stupid and pathetic moron loser worthless scum trash clown " * 40 + "the of and to in is that with for on " * 200)
    said = {"1d10t": "idiot", "i.d.i.o.t": "idiot", "i/d/i/o/t": "idiot", "idiooot": "idiot", "m0r0n": "moron", "$cum": "scum", "p@thetic!!": "pathetic", "plain,": "plain", "%%%": "", "іdіоt": "idiot", "trash/and": "trash and"}
    for token, word in said.items():
        assert toxicity.restore(model, token, {}) == word, token
    assert toxicity.folded("ID\u200bI\u00adO\u0336T ｉｄｉｏｔ") == "idiot idiot"
    assert "idiot" in toxicity.words(model, "you i d i o t there", {})[0]
    lexicon = toxicity.Lexicon({"idiot": 5.0, "trash": 4.0})
    for text in ("tra sh", "the tr ash is", "tr a sh", "ídïot", "idioot", "you IDIÓT!", "t-r-a-s-h", "i. d. i. o. t."):
        assert toxicity.numbers(model, lexicon, text, {}, {})[0] >= 4.0, text
    for text in ("the id of it", "is that the trash-free", "tra and sh", "", "i d"):
        assert toxicity.numbers(model, lexicon, text, {}, {})[0] == (4.0 if "trash" in text else 0.0), text


def test_runs_of_single_characters():
    model, lexicon = model_of("you are a idiot and the ass is here to see it all " * 200), toxicity.Lexicon({"idiot": 5.0, "idio~": 4.0, "ass": 3.0})
    for said in ("you are a i d i o t", "y o u i d i o t", "you are a 1 d 1 0 t", "& i d i o t", "id" + "i" * 60 + "ot", "y o u a r e t h e i d i o t a n d h e r e t o s e e i t a l l"):
        assert toxicity.numbers(model, lexicon, said, {}, {})[0] == 5.0, said
    assert toxicity.numbers(model, lexicon, "a s s", {}, {})[0] == 3.0
    assert toxicity.run_hits(lexicon.weights, lexicon.lengths, "youidiotsass") == {"idiot": 5.0, "ass": 3.0}
    assert toxicity.numbers(model, lexicon, "y o u a r e", {}, {})[0] == 0.0
    assert len(toxicity.viterbi(model, "ab1" * 5000)) > 0


HIDDEN = {"leet": lambda w: w.translate(str.maketrans("aeiost", "431057")), "slash": "/".join, "spaced": " ".join, "split": lambda w: f"{w[: len(w) // 2]} {w[len(w) // 2 :]}", "zero width": "\u200b".join,
          "look-alike": lambda w: w.translate(str.maketrans("aceopxyi", "асеорхуі")), "repeats": lambda w: "".join(c * (40 if i == 1 else 1) for i, c in enumerate(w)), "wide": lambda w: "".join(chr(ord(c) + 0xFEE0) for c in w)}


def test_decoding_decides(spark, monkeypatch):
    """Hidden words of the learnt lexicon score as the plain words do, and without decoding most are missed; held-out rows are caught."""
    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, lexicon, w = toxicity.learn(table, labels)
    held = table.join(labels, "doc_id").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1").orderBy("doc_id").collect()

    def toxic(text):
        return 1 / (1 + np.exp(-(np.array(toxicity.numbers(model, lexicon, text, {}, {})) @ w[:4] + w[4]))) >= toxicity.THRESHOLD

    called = [(r["toxic"], toxic(r["text"])) for r in held]
    assert sum(c for t, c in called if t) >= 0.7 * sum(t for t, _ in called) and sum(c for t, c in called if not t) <= 0.02 * len(called)
    clean = [r["text"] for r, (t, c) in zip(held, called) if not t and not c and len(r["text"]) > 300][:25]
    plain = sorted(x for x in lexicon.words if len(x) > 3 and x.isascii())

    def caught(hide):
        out = 0
        for k, text in enumerate(clean):
            tokens = text.split(" ")
            for n in (k, k + 3):
                tokens.insert(1 + (7 * n) % len(tokens), hide(plain[n % len(plain)]))
            out += toxic(" ".join(tokens))
        return out

    most = caught(str)
    assert most >= 0.95 * len(clean)
    with_decoding = {name: caught(hide) for name, hide in HIDDEN.items()}
    assert min(with_decoding.values()) >= 0.9 * most, with_decoding
    monkeypatch.setattr(toxicity, "viterbi", lambda model, token, boundaries=False: token)
    monkeypatch.setattr(toxicity, "joined_words", lambda *a: set())
    without = {name: caught(hide) for name, hide in HIDDEN.items() if name not in ("zero width", "wide", "spaced")}  # folding and substrings find those
    assert max(without.values()) <= 0.2 * most, without


def test_toxicity_edges(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["mq_score"] <= 1 for r in rows)
    assert len({r["mq_score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1 and set(odd.columns) < set(rows[0].asDict())
    assert toxicity.toxicity(empty(odd), labels.where("false")).count() == 0
    assert {round(r["mq_score"], 6) for r in toxicity.toxicity(odd, labels.where("false")).collect()} == {0.05}
    filtered = corpus_pipeline.toxicity_filter(spark, odd, SF)
    assert filtered.columns == odd.columns and filtered.count() == odd.count()


# ---- vectors
def brute_vectors(rows, threshold=0.95):
    """(n_links, component_id) of each (id, vector) row."""
    good = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {k: (0, i) for k, (i, _) in enumerate(rows)}
    for dim in {len(rows[k][1]) for k in good}:
        at = [k for k in good if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in at])
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        seen = set()
        for s in range(len(at)):
            if s not in seen:
                group, front = {s}, [s]
                while front:
                    front = [t for f in front for t in np.flatnonzero(near[f]).tolist() if t not in group and not group.add(t)]
                seen |= group
                for t in group:
                    out[at[t]] = (int(near[t].sum()), min(rows[at[g]][0] for g in group))
    return [out[k] for k in range(len(rows))]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 20))
    vectors_ = [v + rng.normal(size=20) * s for v in base for s in (0.0, 0.03, 0.03, 0.2)]
    rows = list(enumerate([r.tolist() for r in vectors_] + [vectors_[0].tolist(), None, [0.0] * 20, [float("nan")] * 20, [1.0] * 19, [None] * 20, []]))
    rows += [(1, vectors_[1].tolist()), (1, vectors_[9].tolist()), (2, vectors_[0].tolist()), (3, None)]  # repeated ids: equal and other vectors
    df = spark.createDataFrame([(k, r, "x") for k, r in rows], "vec_id long, embedding array<double>, n_links string")
    for block in (8, 4096):
        got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df, block=block).collect())
        want = collections.Counter((i, n, c, c == i) for (i, _), (n, c) in zip(rows, brute_vectors(rows)))
        assert sum(got.values()) == len(rows) and sum((got & want).values()) >= 0.97 * len(rows)
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_recall_of_the_hashing(spark):
    """Pairs at cosines from 0.95 to 0.99 in 64 dimensions, as many as in the README's figures."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(600):
        v, w = rng.normal(size=(2, 64))
        v /= np.linalg.norm(v)
        w -= (w @ v) * v
        c = rng.uniform(0.951, 0.99)
        rows += [(2 * k, v.tolist()), (2 * k + 1, (c * v + np.sqrt(1 - c * c) * w / np.linalg.norm(w)).tolist())]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = got.where("n_links = 1 and component_id = vec_id - vec_id % 2").count()
    assert found >= 0.97 * len(rows) and got.where("n_links > 1").count() == 0 and got.where("kept").count() == len(rows) - found // 2


# ---- queries and pipeline
CONTRACTS = {
    "op1_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op4_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op7_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_vectors": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
}


@pytest.fixture(scope="module")
def texts_of(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contracts(spark, name, texts_of):
    """Columns, types and rows of each query, and the digests of its contract by plain Python."""
    df = llm.queries()[name](spark, SF)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == CONTRACTS[name]
    rows = df.collect()
    if name == "op10_vectors":
        given = [(r["vec_id"], list(r["embedding"]) if r["embedding"] else None) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
        want = {i: w for (i, _), w in zip(given, brute_vectors(given))}
        assert len(rows) == len(given) and all(r["n_links"] <= want[r["vec_id"]][0] and r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
        return
    assert {r["doc_id"] for r in rows} == set(texts_of) and (name == "op4_packing" or len(rows) == len(texts_of))
    if name == "op2_sharding":
        slots = collections.defaultdict(list)
        for r in rows:
            raw = texts_of[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
            slots[r["shard"]].append(r["slot"])
        assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    elif name == "op3_media":
        for r in rows:
            padded, n = media.pad(texts_of[r["doc_id"]])
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            stored = media.encode(padded)
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    elif name == "op7_pii":
        for r in rows:
            base = base_spans(texts_of[r["doc_id"]])
            kinds = collections.Counter(x.split(":")[0] for x in base.split(",") if x)
            assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    elif name == "op9_toxicity":
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_odd_rows_of_stages(spark, odd):
    """Nulls, empties, repeats, clashing names and empty tables in the stages that the other tests give clean rows only."""
    mixed = corpus_pipeline.mixing(spark, odd, SF)
    assert mixed.columns == odd.columns and mixed.count() <= 3 * odd.count() and corpus_pipeline.mixing(spark, empty(odd), SF).count() == 0
    pieces = corpus_pipeline.packing(spark, odd.withColumn("piece", F.lit("x")), SF)
    assert pieces.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count() and corpus_pipeline.packing(spark, empty(odd), SF).count() == 0
    lines = corpus_pipeline.line_dedup(spark, odd, SF)
    assert lines.columns == odd.columns and lines.count() <= odd.count()
    assert corpus_pipeline.toxicity_filter(spark, empty(odd), SF).count() == 0 and corpus_pipeline.ngram_join(spark, empty(odd), SF).count() == 0


def test_sharding_of_one_repeated_row(spark):
    """Copies of one row are dealt to all partitions and shards."""
    many = docs(spark, ["same text"]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4000)))).drop("n")
    got = sharding.shard(many, ["doc_id"], rows_per_partition=100).groupBy("mq_shard").agg(F.count("*").alias("n"), F.max("mq_slot").alias("top")).collect()
    assert [(r["n"], r["top"]) for r in got] == [(500, 499)] * 8


@pytest.mark.parametrize("name", ["op1_mixing", "op6_ngram_join"])
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as from '{SF}/documents.parquet'")
    got, want = llm.queries()[name](spark, SF).toPandas(), con.sql(llm.oracle_sql()[name]).df()
    assert sorted(map(repr, got[want.columns].values.tolist())) == sorted(map(repr, want.values.tolist()))


def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]
    clean = corpus_pipeline.toxicity_filter(spark, d, SF)
    assert clean.columns == d.columns and 0 < clean.count() <= d.count()
    lines = corpus_pipeline.line_dedup(spark, clean, SF)
    assert lines.columns == d.columns
    texts = sorted((r["doc_id"], r["text"]) for r in lines.collect())
    given = sorted((r["doc_id"], r["text"]) for r in clean.collect())
    gone = brute_lines(given)
    left = [(i, t if at not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[at]), at in gone) for at, (i, t) in enumerate(given)]
    assert texts == [(i, t) for i, t, cut in left if not cut or re.search(r"[^\x20\x09-\x0D]", t)]
    comp = brute([t for _, t in texts], 5, 80)
    kept = {r["doc_id"] for r in corpus_pipeline.ngram_join(spark, lines, SF).collect()}
    assert kept == {texts[k][0] for k, (_, c) in enumerate(comp) if c == k}
    assert corpus_pipeline.run(spark, SF).count() > 0


# ---- periodic runs
def brute_runs(x, length=24, exponent=3):
    found = {}
    for p in range(1, len(x) // exponent + 1):
        i = 0
        while i < len(x) - p:
            j = i
            while j < len(x) - p and x[j] == x[j + p]:
                j += 1
            if j > i and j - i + p >= max(length, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return {(s, m, p) for (s, m), p in found.items()}


def test_runs_against_all_lags():
    rng = random.Random(3)
    for _ in range(300):
        n, k = rng.randint(0, 260), rng.choice([1, 2, 3, 60])
        x = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 4)):
            if n > 30:
                a, p = rng.randrange(n - 24), rng.choice([1, 2, 5, 7, 8, 9, 12, 16, 17, 30])
                for i in range(a + p, min(n, a + rng.randint(24, 150))):
                    x[i] = x[i - p]
        length, exponent = rng.choice([(24, 3), (24, 3), (6, 3), (1, 2), (40, 2)])
        ids, m = np.array(x, np.int32), rng.randint(1, 40)
        want = brute_runs(x, length, exponent)
        assert periodic_runs.runs(ids, min_length=length, min_exp=exponent) == want
        assert periodic_runs.runs(ids, 1, m, length, exponent) | periodic_runs.runs(ids, m, None, length, exponent) == want  # ranges of lags


def brute_summary(text, doc_id):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (fractions.Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


REPEATING = [*ODD, "a b c " * 12, "one two three four five six seven " * 5 + "end", "x\x1cy \x0bz " * 20, ("w " * 30 + "v ") * 4]


@pytest.mark.parametrize("split", [1 << 24, 40])
def test_periodic_runs_of_rows(spark, split):
    many = docs(spark, REPEATING * 3)  # ids decide which rows repeat their tail
    many = many.unionAll(many.where("doc_id = 11")).unionAll(many.where("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long")))
    got = periodic_runs.periodic_runs(many, plant=True, split=split).collect()
    texts = many.select("doc_id", "text").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((r["doc_id"], *brute_summary(r["text"], r["doc_id"]))) for r in texts)
    assert any(r["n_runs"] for r in got) and periodic_runs.periodic_runs(empty(many)).count() == 0


def test_periodic_runs_contract(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 3000)
    want = {r["doc_id"]: brute_summary(r["text"], r["doc_id"]) for r in some.select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic_runs.op11(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and {k: got[k] for k in want} == want


# ---- collocations
def brute_collocations(rows, least, absorb=100):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                f.update((lang or "und", tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    often = {k: v for k, v in f.items() if v >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in often.items():
        inside = any(k[0] == lang and len(k[1]) > len(w) and 100 * v >= absorb * a and any(k[1][i : i + len(w)] == w for i in range(len(k[1]))) for k, v in often.items())
        if len(w) > 1 and not inside:
            cuts = [(1000 * a * n[lang] // (often[lang, w[:k]] * often[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out[lang].append((-score, -a, b" ".join(w), often[lang, w[:k]], often[lang, w[k:]], n[lang]))
    return {(lang, k + 1, p.decode(), -a, left, r, total, -s) for lang, x in out.items() for k, (s, a, p, left, r, total) in enumerate(sorted(x))}


@pytest.mark.parametrize(("block", "sent"), [(1, True), (50, False), (1 << 20, True)])
def test_collocations_against_brute_force(spark, block, sent, monkeypatch):
    if not sent:  # as if frequent words and pairs were too many for a broadcast
        monkeypatch.setattr(collocations, "sendable", lambda *_: False)
        monkeypatch.setattr(collocations, "PAIRS_SENT", 0)
    rng = random.Random(5)
    words = ["the", "The", "of", "ab", "été", "x\x1cy", "\x0e", "zz z"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 90))), rng.choice(["en", "fr", None, "und"])) for _ in range(40)]
    rows += [(None, "en"), ("", None), ("a a a a a a a", "en"), (" \t. ,", "de"), ("one", "de"), *[("in the long long run we are", "x")] * 9]
    table_ = spark.createDataFrame([(t, lang, 1, 2, "k") for t, lang in rows], "text string, lang string, n long, id long, key string")
    for least in (2, 5):
        got = {tuple(r) for r in collocations.collocations(table_, least=least, block=block, top=None).collect()}
        assert got == brute_collocations(rows, least) and got
    some = {tuple(r) for r in collocations.collocations(table_, least=2, top=3, block=block).collect()}
    assert some == {r for r in brute_collocations(rows, 2) if r[1] <= 3}
    assert collocations.collocations(empty(table_)).count() == 0


def test_chunks_keep_words():
    for text in (b"ab cd.ef  gh", b"", b"x" * 50, b"a " * 40, b"abcdefghij.k l"):
        for size in (1, 3, 8):
            parts = list(collocations.chunks(text, size))
            assert b"".join(parts) == text and all(p[-1:] in b" \t\n." for p in parts[:-1])


# ---- decontamination
def brute_matches(rows, items, width=10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    cut = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            cut[tuple(w[i : i + width])].add(item)
    out = []
    for doc, text in rows:
        w, hit, seen = words(text), set(), set()
        for k in {len(c) for c in cut}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in cut:
                    hit |= set(range(i, i + k))
                    seen |= {str(x) for x in cut[tuple(w[i : i + k])] if x is not None}
        out.append((doc, len(w), len(hit), sorted(seen)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(decontamination, "small", decontamination.small if limit else lambda df: df)
    rng = random.Random(8)
    words = ["The", "of", "a1", "éTé", "café", "x-y", "u", "v", "\U0001F600"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, line(rng.choice([3, 9, 10, 11, 25]))) for k in range(12)] + [(3, "only one"), (100, "u u u u u u u u u u u u"), (101, ""), (102, None), (103, "?!"), (None, "never named here"), (104, "zebra seen nowhere")]
    rows = [(k, (line(60) + " " + (rng.choice(items)[1] or "") + ". " + line(20)) if k % 3 else line(40)) for k in range(60)]
    rows += [(1, None), (2, ""), (3, "..."), (None, "NEVER named-here"), (5, "u " * 300), *[(200 + k, "only, one! only one") for k in range(20)], (200, "only, one! only one")]
    d = spark.createDataFrame([(k, t, "k", 1) for k, t in rows], "doc_id long, text string, key string, n long")
    b = spark.createDataFrame([(k, t, "w") for k, t in items], "item_id long, text string, window string")
    got = decontamination.exact_matches(d, b).collect()
    assert sorted(((r["mq_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == brute_matches(rows, items)
    assert decontamination.exact_matches(empty(d), b).count() == 0 and decontamination.exact_matches(d, empty(b)).where("n_hit > 0").count() == 0


def test_near_matches(spark):
    d = docs(spark, ["red x x green x blue " + "x " * 50, "red " + "x " * 40 + "green blue", "blue Green RED", None, "", "red green"])
    b = spark.createDataFrame([(1, "Red, green, blue!"), (2, "red"), (3, "red unknown"), (4, None), (None, "red")], "item_id long, text string")
    got = {(r["mq_id"], r["item"]) for r in decontamination.near_matches(d, b, within=10).collect()}
    assert got == {(0, "1"), (2, "1"), (0, "2"), (1, "2"), (2, "2"), (5, "2")}
    assert (1, "1") in {(r["mq_id"], r["item"]) for r in decontamination.near_matches(d, b, within=60).collect()}


def test_lines_of_null_ids(spark):
    line = "this very line stands in many documents of all kinds"
    df = spark.createDataFrame([(1, f"{line}\nfirst"), (3, f"{line}\nthird"), (None, f"{line}\nnone"), (None, f"{line}\nnone again"), (None, None)], "doc_id long, text string")
    got = {r["text"]: r["mq_dropped"] for r in line_dedup.without_lines(df).collect()}
    assert got == {f"{line}\nfirst": 0, "third": 1, "none": 1, "none again": 1, None: 0}
    alone = df.where("doc_id is null")
    assert {r["mq_dropped"] for r in line_dedup.without_lines(alone).collect()} == {0}  # one document


def test_quality_level_of_a_language_with_one_document(spark):
    words = "we are happy to say that the weather is fine today and that all is well".split()
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(words) for _ in range(40)), "en") for k in range(60)] + [(100 + k, " ".join(rng.choice(["und", "wir", "sind", "froh"]) for _ in range(40)), "de") for k in range(12)] + [(200, "#@ 0x1f " * 30, "en"), (201, "#@ 0x1f " * 30, "xx")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k, _, lang in rows if lang != "xx" and k != 200], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality(docs_, labels).collect()}
    assert got[0]["threshold"] != got[100]["threshold"] and not got[200]["kept"] and not got[201]["kept"] and sum(got[k]["kept"] for k in range(60)) >= 57


def test_clips_decode_the_frames_of_many_files_together(monkeypatch):
    made = [media.encode(bytes([k % 7]) * 1000) for k in range(40)]
    broken = made[3].replace(b"\xff\xc0", b"\xff\xc2", 1)  # a progressive frame
    files, calls, plain = [*made, broken, b"no media"], [], media.decoded
    monkeypatch.setattr(media, "decoded", lambda jpegs: calls.append(len(jpegs)) or plain(jpegs))
    rows = media._clip_rows(list(range(len(files))), files)
    assert len(calls) == 1 and sum(calls) == 41  # a call for each file before
    assert [r[0] for r in rows] == list(range(42)) and all(r[5] is None and r[4] == 1 for r in rows[:40]) and all(r[5] for r in rows[40:])
    assert [r[1:5] for r in rows[:40]] == [media.clips(m)[0] for m in made]
