"""The ten operators against brute force, libraries and round trips, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from convolake.llm import bpe, dac, line_dedup, mixing, quality, quality_rules, sharding, simhash, threshold, toxicity
from convolake.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, name string"


def _texts(n: int, seed: int = 3) -> list[str]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé漢") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    texts = []
    for _ in range(n):
        lines = [" ".join(rnd.choices(words, k=rnd.randrange(1, 40))) for _ in range(rnd.randrange(1, 6))]
        texts.append("\n".join(lines))
    for i in range(0, n - 1, 7):  # exact and near copies
        texts[i + 1] = texts[i] if i % 2 else texts[i].replace("a", "b", 1)
    return texts


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, "en", f"src{i % 5}", len(t), 1, "x") for i, t in enumerate(_texts(120))]
    found += [(500, None, None, None, None, None, None), (501, "", "en", None, 0, 1, ""), (502, " \n\t", "en", "src1", 3, 1, "")]
    found += [(503, "a" * 4000, "en", "src2", 4000, 1, ""), (503, "a" * 4000, "en", "src2", 4000, 1, "")]
    found += [(None, "no id here, but text", "en", "src0", 20, 1, "")]
    return found


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 4 != 0), int(i % 9 == 0)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def _collect(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "query",
    [
        bpe.op1_byte_bpe, threshold.op2_threshold, mixing.op3_mixing, dac.op4_dac, quality.op5_quality, sharding.op6_sharding,
        line_dedup.op7_line_dedup, toxicity.op8_toxicity, quality_rules.op9_quality_rules, simhash.op10_simhash,
    ],
)
def test_empty_tables_give_no_rows(spark, empty_dir, query):
    assert query(spark, empty_dir).collect() == []


def test_op1_agrees_with_tiktoken_and_decodes(spark, sf_dir, rows):
    codec = bpe.Codec.load(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    expected = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        back = (text or "").encode()
        expected.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest()))
    assert _collect(bpe.op1_byte_bpe(spark, sf_dir)) == sorted(expected, key=repr)


def test_op1_on_white_space_and_marks():
    codec = bpe.Codec.load(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice(" \t\n\r\x0b\x1c\x85　\xa0'stabé1٣!?漢🙂") for _ in range(rnd.randrange(40)))
        assert memoryview(codec.encode(text)).cast("I").tolist() == library.encode_ordinary(text)


def test_op1_encode_and_decode_columns(spark):
    docs = spark.createDataFrame([(1, "Hello there"), (2, None), (3, "")], "doc_id long, text string")
    back = bpe.decode(bpe.encode(docs)).select("doc_id", F.col("decoded").cast("string"), F.size("ids") > 0)
    assert _collect(back) == [(1, "Hello there", True), (2, "", False), (3, "", False)]


def test_op2_agrees_with_brute_force(spark, tmp_path):
    rnd = np.random.default_rng(2)
    vectors = rnd.normal(size=(300, 8)).astype(np.float32)
    vectors[100:200] = vectors[50]  # a third of all are one vector
    data = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    data += [(400, None, 0), (450, [1.0, None] + [0.0] * 6, 0), (500, [float("nan")] * 8, 0), (550, [float("inf")] * 8, 0)]
    data += [(None, [0.0] * 8, 0), (600, [0.0] * 8, 0)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    part = {i: np.floor(256 * np.array(v, np.float64)).astype(int) for i, v, _ in data if i is not None and (i < 400 or i == 600)}
    expected = []
    for q in (i for i in part if i % 50 == 0):
        best = sorted((-int(part[q] @ v), i) for i, v in part.items() if i != q)[:5]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert _collect(threshold.op2_threshold(spark, str(tmp_path))) == sorted(expected, key=repr)


def test_op2_takes_components_of_any_size(spark, tmp_path):
    rnd = random.Random(3)
    data = [(i, [rnd.uniform(-1, 1), rnd.uniform(-1, 1)]) for i in range(150)]
    data += [(151, [1e14, 0.0]), (152, [-3e12, 7.5]), (153, [5e9, 5e9]), (200, [0.004, -1e3]), (250, [1e-30, -1e-30]), (300, [])]
    spark.createDataFrame(data, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    part = {i: [math.floor(256 * x) for x in v] for i, v in data}
    expected = []
    for q in (i for i in part if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(part[q], v)), i) for i, v in part.items() if i != q)[:5]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert _collect(threshold.op2_threshold(spark, str(tmp_path))) == sorted(expected, key=repr)


def test_op2_stops_early_and_stays_exact():
    rnd = np.random.default_rng(4)
    matrix = (rnd.normal(size=(2000, 4)) * 100).astype(np.int64)
    matrix[:5] += 1000
    lists = threshold.Lists(4, np.arange(2000, dtype="<i8").tobytes(), matrix.astype(np.float64).tobytes(), np.argsort(matrix, axis=0, kind="stable").T.astype("<i4").copy().tobytes())
    query = np.array([3.0, 2.0, 1.0, 1.0])
    scores = matrix @ query.astype(np.int64)
    assert lists.best(query, -1, 5) == [(int(scores[i]), int(i)) for i in np.lexsort((np.arange(2000), -scores))[:5]]


def test_op3_meets_targets(spark, sf_dir, rows):
    import re

    found = mixing.mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert len(found) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
    for source, aim in target.items():
        assert abs(taken[source] - aim) <= 1 and aim <= 3 * sizes[source] + 1e-6
    words = sum(len(re.findall(mixing.WORD, t or "")) for _, t, *_ in rows)
    assert sum(target.values()) == pytest.approx(words)
    query = mixing.op3_mixing(spark, sf_dir)
    assert sum(r["taken"] for r in query.collect()) == sum(taken.values())
    assert _collect(query) == _collect(mixing.op3_mixing(spark, sf_dir))


def test_op3_water_filling(spark):
    sources = [("a", 10, 1), ("b", 1000, 5), ("c", 500, 2), ("d", 20, 1), (None, 70, 1)]
    got = {r["source"]: r for r in mixing.targets(spark.createDataFrame(sources, "source string, source_size long, n long")).collect()}
    weights = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    left, open_, target = 1600.0, {s for s, *_ in sources}, {}
    size = {s: n for s, n, _ in sources}
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * size[s]}
        if not full:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in full}
        left -= sum(3.0 * size[s] for s in full)
        open_ -= full
    for s, t in target.items():
        assert got[s]["target"] == pytest.approx(t)
    balance = sum(r["target"] * r["tilt"] for r in got.values())
    assert balance == pytest.approx(0, abs=1e-6)


def test_op3_position_inverts_the_schedule(spark):
    for tilt in (-0.8, 0.0, 0.5):
        for u in (0.0, 0.2, 0.9, 1.0):
            asked = 100.0 * (u + tilt * (u - u * u))
            got = spark.range(1).select(mixing.position(F.lit(asked), F.lit(100.0), F.lit(tilt))).first()[0]
            assert got == pytest.approx(u, abs=1e-9)


def test_op4_agrees_with_the_library(spark, sf_dir, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(dac.VOCABULARY))
    expected, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert _collect(dac.op4_dac(spark, sf_dir)) == sorted(expected, key=repr)


def test_op4_words_agree_with_the_library():
    encoder = dac.Encoder(public_tokenizers.path(dac.VOCABULARY))
    rnd = random.Random(6)
    for _ in range(1500):
        text = "".join(rnd.choice(" \t\n\x1c\x85　'stabHIKéÉ̱́̇.,;!?1#ß漢") for _ in range(rnd.randrange(40)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_op4_added_tokens_agree_with_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(dac.VOCABULARY)
    library, encoder, rnd = Tokenizer.from_file(path), dac.Encoder(path), random.Random(8)
    assert library.encode("one <|endoftext|> two", add_special_tokens=False).ids == [637, 49407, 1237]
    parts = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<", "One", " ", "é", "\u0338", "\n", "7", "İ"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(9))) for _ in range(1500)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    spark.createDataFrame(list(enumerate(texts[:50])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected, start = [], 0
    for doc_id, text in enumerate(texts[:50]):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        expected.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert _collect(dac.op4_dac(spark, str(tmp_path))) == sorted(expected, key=repr)


@pytest.mark.parametrize("top", [1, 200, 70_000, 1 << 31])
def test_op4_random_access(top):
    rnd = np.random.default_rng(top)
    ids = rnd.integers(0, top, 3000).astype(np.uint32)
    segment = dac.Segment(dac.pack(ids, np.array([0, 1000, 1000, 3000])))
    assert [segment.token(i) for i in range(0, 3000, 7)] == ids[::7].tolist()
    assert segment.tokens(777, 2001).tolist() == ids[777:2001].tolist()
    assert segment.document(1).tolist() == [] and segment.document(2).tolist() == ids[1000:].tolist()


def test_op5_learns_planted_junk(spark, tmp_path):
    rnd = random.Random(9)
    docs, labels = [], []
    for i in range(240):
        junk = i % 3 == 0
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(30, 250))]
        if junk:
            at = rnd.randrange(len(words))
            words[at:at] = ["BUY!!"] * 60
        docs.append((i, " ".join(words)))
        labels.append((i, int(not junk), 0))
    spark.createDataFrame([*docs, (999, None), (None, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op5_quality(spark, str(tmp_path)).collect()
    assert len(got) == 242 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held if r["doc_id"] < 240) >= 0.95 * len(held)


def test_op5_gradients():
    rng = np.random.default_rng(0)
    net = quality.Attention(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), rng)
    x, firsts, y = rng.normal(size=(7, quality.WIDTH)), np.array([0, 3]), np.array([1.0, 0.0])

    def loss():
        s = net.forward(x, firsts)["s"]
        return float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean())

    grads = net.gradients(x, firsts, y, np.ones(2))
    for name, value in net.p.items():
        at = tuple(0 for _ in value.shape)
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        down = loss()
        value[at] += 1e-5
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_op6_table_is_even_and_stable():
    shards = {f"s{k}": 1 for k in range(10)}
    full = sharding.lookup(shards, 1009)
    counts = Counter(full)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup({s: 1 for s in shards if s != "s3"}, 1009)
    moved = sum(a != b for a, b in zip(full, fewer, strict=True) if a != "s3")
    assert moved < 0.25 * 1009
    weighed = Counter(sharding.lookup({"a": 3, "b": 1}, 1009))
    assert weighed["a"] / weighed["b"] == pytest.approx(3, rel=0.02)
    with pytest.raises(ValueError):
        sharding.lookup(shards, 1000)


def test_op6_places_each_row_by_its_slot(spark, sf_dir, rows):
    found = sharding.op6_sharding(spark, sf_dir).collect()
    slots = sharding.lookup({f"shard-{k:03d}": 1 for k in range(sharding.SHARDS)})
    assert len(found) == len(rows)
    for r in found:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r["slot"], r["shard"]) == (slot, slots[slot])


def test_op7_counts_overlaps_exactly():
    rnd = random.Random(4)
    for alphabet in ("ab ", "abcdefghij", "".join(map(chr, range(0x4E00, 0x9000)))):
        lines = ["".join(rnd.choices(alphabet, k=rnd.randrange(1, 60))) for _ in range(40)]
        for split in (0, 15):
            shared, sizes = line_dedup.overlaps(lines, split)
            for i in range(split or 40):
                for j in range(split, 40):
                    assert i == j or shared[i, j - split] == len(line_dedup.shingles(lines[i]) & line_dedup.shingles(lines[j]))
            assert sizes.tolist() == [len(line_dedup.shingles(x)) for x in lines]


def test_op7_marks_and_numbers_agree_with_sets():
    rnd = random.Random(7)
    for alphabet in ("ab ", "abcdefghij\u00e9", "ab\u6f22\u5b57"):
        lines = ["".join(rnd.choices(alphabet, k=rnd.choice([1, 4, 5, 30, 400]))) for _ in range(60)]
        lines += [x[:-1] + "#" for x in lines]
        sets = [line_dedup.shingles(x) for x in lines]
        hashes, counts = line_dedup.shingle_hashes(lines)
        bits = line_dedup.marks(np.repeat(np.arange(len(lines)), counts), hashes, len(lines))
        sizes = np.array([len(x) for x in sets])
        for i in range(len(lines)):
            exact = [len(sets[i] & y) / len(sets[i] | y) for y in sets]
            assert [line_dedup.jaccard(lines[i], y) for y in lines] == exact
            may = line_dedup.may_be_alike(np.repeat(bits[i : i + 1], len(lines), 0), bits, np.full(len(lines), sizes[i]), sizes)
            assert all(m or e < line_dedup.SIMILARITY for m, e in zip(may, exact, strict=True))


def test_op7_marks_of_groups_agree_with_those_of_pairs():
    rnd = random.Random(8)
    lines = ["".join(rnd.choices("abcdefghij ", k=rnd.choice([5, 60, 300]))) for _ in range(30)]
    lines += [x[: len(x) // 2] + "#" + x[len(x) // 2 :] for x in lines]
    hashes, counts = line_dedup.shingle_hashes(lines)
    bits = line_dedup.marks(np.repeat(np.arange(60), counts), hashes, 60)
    sizes = np.array([len(line_dedup.shingles(x)) for x in lines])
    for split in (0, 25):
        left, right = (np.repeat(np.arange(split or 60), 60 - split), np.tile(np.arange(split, 60), split or 60))
        expected = line_dedup.may_be_alike(bits[left], bits[right], sizes[left], sizes[right]).reshape(split or 60, -1)
        assert (line_dedup.may_link(bits, sizes, split) == expected).all() and not expected.all()


@pytest.mark.parametrize("hot", [False, True])
def test_op7_shuffles_bands_in_blocks(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(line_dedup, "HOT_ROWS", -1_000_000)
    monkeypatch.setattr(line_dedup, "SLOTS", 8)
    monkeypatch.setattr(line_dedup, "SALTS", 3)
    monkeypatch.setattr(line_dedup, "SLOT_SAMPLE", 1.0)
    rnd = random.Random(9)
    lines = ["".join(rnd.choices("abcdefghijklmnop ", k=80)) for _ in range(150)]
    lines += [x[:40] + "#" + x[41:] for x in lines[:60]] + [x[:20] + "#" + x[21:] for x in lines[:30]] + lines[:40]
    texts = [None, "", *["\n".join(lines[k : k + 10]) for k in range(0, len(lines), 10)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").withColumn("doc_id", F.col("row"))
    schema = "row long, doc_id long, n_lines long, names array<long>, fresh binary, bands binary"
    kept = docs.repartition(4).mapInArrow(line_dedup._named, schema).localCheckpoint()
    each = sorted({line_dedup.normal(x) for x in lines})
    buckets = defaultdict(set)
    for line, bands in zip(each, line_dedup._all_bands(each).tolist(), strict=True):
        for band in bands:
            buckets[band].add(line_dedup.name(line))
    shelves, tied = line_dedup._shelves(kept)
    found, pivots = defaultdict(set), defaultdict(set)
    for r in shelves.collect():
        found[r["band"]].add(r["name"])
        pivots[r["band"]].add(r["pivot"])
        assert r["many"] or len(buckets[r["band"]]) == 2
    several = {band: names for band, names in buckets.items() if len(names) > 1}
    assert len(several) > 100 and {band: found[band] for band in several} == several
    assert all(pivots[band] <= names for band, names in several.items())
    if hot:
        assert max(map(len, pivots.values())) > 1 and tied.count() > 0
    else:
        assert set(found) == set(several) and max(map(len, pivots.values())) == 1 and tied.count() == 0


def test_op7_bands_find_pairs_at_the_threshold():
    rnd = random.Random(5)
    for length in (49, 120, 900):
        pairs = []
        while len(pairs) < 600:
            a = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=length))
            b = list(a)
            for at in rnd.sample(range(length), max(1, length // 55)):
                b[at] = "#"
            if line_dedup.jaccard(a, "".join(b)) >= line_dedup.SIMILARITY:
                pairs.append((a, "".join(b)))
        left, right = (line_dedup._all_bands(list(x)) for x in zip(*pairs, strict=True))
        assert (left == right).any(axis=1).mean() >= 0.98


def test_op7_reads_lines_as_they_are_compared():
    rnd = random.Random(6)
    for _ in range(2000):
        text = "".join(rnd.choice("aB\u0130\u03a3 \t\n\r\x0b\x1c\x85\u3000\xa0\u00e9") for _ in range(rnd.randrange(30)))
        expected = [(i, n) for i, line in enumerate(text.split("\n")) if (n := line_dedup.normal(line))]
        assert line_dedup._lines(text) == expected


def test_op7_links_lines_after_one_substitution(spark, tmp_path):
    rnd = random.Random(12)
    lines = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60)).strip() + "end of it" for _ in range(40)]
    assert all(len(line_dedup.normal(x)) > 49 for x in lines)
    near = [x[:30] + "#" + x[31:] for x in lines]
    docs = [(1, "\n".join(lines)), (2, "\n".join(near))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.op7_line_dedup(spark, str(tmp_path)).collect()}
    alike = [k for k, (a, b) in enumerate(zip(lines, near, strict=True)) if line_dedup.jaccard(*map(line_dedup.normal, (a, b))) >= 0.8]
    assert len(alike) > 30 and found == {1: [], 2: alike}


@pytest.mark.parametrize("small", [False, True])
def test_op7_agrees_with_all_pairs(spark, sf_dir, rows, monkeypatch, small):
    if small:  # every slot is hot, buckets have many blocks, every name is frequent
        for setting, value in (("HOT_ROWS", -1_000_000), ("SALTS", 3), ("BLOCK_ROWS", 2), ("FREQUENT", 100_000)):
            monkeypatch.setattr(line_dedup, setting, value)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    lines = [(n, place, line) for n, r in enumerate(ordered) for place, line in line_dedup._lines(r[1])]
    texts = sorted({x for *_, x in lines})
    parent = {x: x for x in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if line_dedup.jaccard(a, b) >= line_dedup.SIMILARITY:
                parent[find(a)] = find(b)
    seen, gone = set(), defaultdict(list)
    for n, place, line in sorted(lines, key=lambda x: (ordered[x[0]][0] is None, ordered[x[0]][0] or 0, x[1])):
        if find(line) in seen:
            gone[n].append(place)
        seen.add(find(line))
    expected = sorted(((r[0], gone.get(n, [])) for n, r in enumerate(ordered)), key=repr)
    found = line_dedup.op7_line_dedup(spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["dropped_lines"]) for r in found), key=repr) == expected
    kept = line_dedup.without_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "name"]
    assert line_dedup.op7_line_dedup.__doc__ and kept.filter("doc_id in (500, 501, 502)").count() == 3


def test_op8_learns_planted_words(spark, tmp_path):
    rnd = random.Random(8)
    bad = ["grumfolk", "vexicon", "dratted", "blorgish", "snidely"]
    docs, labels = [], []
    for i in range(600):
        words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(20, 80))]
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    spark.createDataFrame([*docs, (9999, None), (9998, ""), (None, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op8_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.9 * len(held)


def test_op8_windows_cover_every_word():
    for n in range(12):
        words = [f"w{k}" for k in range(n)]
        found = toxicity.windows(" \n".join(words).upper())
        assert {w for x in found for w in x.decode().split()} == set(words)
        assert all(len(x.split()) <= toxicity.WINDOW_WORDS for x in found) and len(found) == max(int(n > 0), n // 2)


def test_op8_distances_agree_with_single_compressions():
    toxic, ordinary = b" you utter dratted vexicon " * 20, b" the river and the boats walk along " * 20
    distance = toxicity.Distance(ordinary, toxic)
    text = "the river and utter dratted vexicon boats walk along you and"
    one_by_one = [
        len(distance._compressors[0].compress(w + b" " * 32)) - len(distance._compressors[1].compress(w + b" " * 32))
        for w in toxicity.windows(text)
    ]
    assert distance.windows(text).tolist() == one_by_one and max(one_by_one) > 3
    assert distance.features(None).tolist() == distance.features(" \n").tolist() == [0.0] * toxicity.N_FEATURES


def test_op8_samples_whole_rows_within_bounds(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 100)
    rows = [(i, i % 2, i, 30 if i else 1000) for i in range(20)]
    taken = toxicity._within_bounds(spark.createDataFrame(rows, "doc_id long, y int, u long, n_bytes long"))
    assert taken == [1, 2, 3, 4, 5, 6]


def _repeat_words(words: list[str]) -> int:
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)})


def test_op9_measures_and_policies(spark, sf_dir, rows):
    import re

    found = {(r["doc_id"], r["n_words"]): r for r in quality_rules.op9_quality_rules(spark, sf_dir).collect()}
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        r = found[doc_id, len(words)]
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == _repeat_words(words)
        assert r["base_failed"] == (len(words) < 10 or 100 * r["n_repeat_words"] > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])
    ledger = quality_rules.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    table = {r["rule"]: r for r in quality_rules.ablations(ledger).collect()}
    bits = [r["fail_bits"] for r in ledger.select("fail_bits").collect()]
    for rule, (bit, _) in quality_rules.RULES.items():
        assert table[rule]["failed"] == sum(b >> bit & 1 for b in bits)
        assert table[rule]["rejected_alone"] == sum(b == 1 << bit for b in bits)


def test_op10_agrees_with_all_pairs(spark, sf_dir, rows):
    def fingerprint(text):
        import re

        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        if not words:
            return 0
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    marks = [fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None and (least[find(i)] is None or r[0] < least[find(i)]):
            least[find(i)] = r[0]
    expected = [(r[0], f"{marks[i]:016x}", least[find(i)]) for i, r in enumerate(rows)]
    assert _collect(simhash.op10_simhash(spark, sf_dir)) == sorted(expected, key=repr)


def test_op10_links_at_three_bits(spark):
    base = 0x0123456789ABCDEF
    marks = [base, base ^ 0b111, base ^ (1 << 63 | 1 << 40 | 1), base ^ 0b1111, 0xFFFF0000FFFF0000]
    marks += [0xAAAA << 16 | k for k in (0, 7 << 40, (7 << 40) | (7 << 50))]
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    got = {r["fp"]: r["root"] for r in simhash.linked(spark.createDataFrame(signed, "fp long").distinct()).collect()}
    groups = defaultdict(set)
    for k, (fp,) in enumerate(signed):
        groups[got[fp]].add(k)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [4], [5, 6, 7]]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(50)}


def test_op10_one_row_of_each_component_where_doc_ids_repeat(spark):
    rnd = random.Random(21)
    a, b, c, d = (" ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)) for _ in range(4))
    same = b.upper()  # the same fingerprint as b
    assert simhash.fingerprint(b) == simhash.fingerprint(same)
    rows = [(5, "zz " + a), (5, b), (2, same), (7, c), (7, d), (7, d), (None, "x"), (None, "x"), (9, None), (8, "")]
    found = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(5, "zz " + a), (2, same), (7, c), (7, d), (None, "x"), (8, "")], key=repr)


def test_op10_one_of_each_keeps_columns_of_any_name(spark):
    columns = "doc_id long, text string, doc string, id int, hash string, root string, n string, fp string, head string"
    rows = [(k % 4, f"text of the class {k % 3}", "d", k % 4, "h", "r", "n", "f", "e") for k in range(12)] + [(None, "z", "d", 1, "h", "r", "n", "f", "e")]
    docs = spark.createDataFrame(rows, columns)
    found = simhash.one_of_each(docs)
    marks = {(r["doc_id"], r["text"]) for r in found.collect()}
    assert found.columns == docs.columns and found.count() == 4 and {t for _, t in marks} == {r[1] for r in rows}
    assert all(tuple(r)[2:] in {x[2:] for x in rows} for r in found.collect())


def test_op10_recall_of_near_copies(spark):
    """One word changed in 500 stays within three bits nearly always, one in 100 seldom: the README gives the limit."""
    rnd = random.Random(2)

    def share(words: int, changes: int) -> float:
        found = 0
        for _ in range(150):
            text = ["".join(rnd.choices("abcdefghijklmnop", k=5)) for _ in range(words)]
            copy = list(text)
            for at in rnd.sample(range(words), changes):
                copy[at] = "changed"
            found += bin(simhash.fingerprint(" ".join(text)) ^ simhash.fingerprint(" ".join(copy))).count("1") <= simhash.MAX_DISTANCE
        return found / 150

    assert share(2000, 1) >= 0.97 and share(500, 1) >= 0.75 and share(100, 1) <= 0.5

def test_clashing_names_are_kept_or_replaced(spark):
    docs = spark.createDataFrame([(1, "ten words or so\nand a line", 5, 6, 7, "x", 8)], "doc_id long, text string, _text int, _words int, _lines int, shard string, slot int")
    row = quality_rules.ledger(docs).first()
    assert (row["_text"], row["_words"], row["_lines"], row["n_words"], row["n_lines"]) == (5, 6, 7, 7, 2)
    found = sharding.placed(docs, {"a": 1})
    assert sorted(found.columns) == sorted(docs.columns) and found.first()["shard"] == "a"
