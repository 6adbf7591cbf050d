"""Each operator against plain Python, on odd rows: NULLs, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shelfproof.llm import (common, jaccard, language, mixing, packing, quality, repair, simhash, sketch, substring,
                            token_counts, topk_search)
from shelfproof.llm.graph import components
from shelfproof.llm.vocabulary import Vocabulary, default_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside, as further columns of the input.
CLASH = ["id", "v", "size", "score", "block", "words", "length", "bucket", "start", "target", "_text", "kept_text",
         "source_size", "draws", "shard", "n_units", "removed", "_mark", "_id", "_kept", "_size", "_n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) + rng.choice(["", "", "", "", ".", ","])
                    for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    long = prose(99, 30_000)
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one two"), (6, long), (7, long.replace("then", "than", 1)),
        (8, "Ünï çøde ñ 日本語 <|endoftext|> it's 12,5  x y é ß"), (9, prose(1, 60)), (10, prose(1, 60)),
        (10, prose(1, 60)), (None, prose(2, 80)), (None, None), (11, prose(3, 50) + ".\n" + prose(4, 60)),
        (12, prose(5, 40) + ".\n" + prose(4, 60)), (13, "A " * 70_000)]
    return rows + [(100 + i, prose(1000 + i, 5 + i % 90)) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx" if i and i % 2 else "yy", [None, "a", "b", "ä", "hot"][(i or 0) % 5], len(t or ""),
             *range(len(CLASH))) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def voc():
    return Vocabulary(default_path())


def ids_of(voc, text: str | None) -> list[int]:
    return voc.tok.encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, empty, voc):
    got = Counter(tuple(r) for r in token_counts.token_counts(docs).collect())
    want = Counter((i, len((t or "").encode()), len(ids_of(voc, t))) for i, t in texts())
    assert got == want
    assert token_counts.token_counts(empty).collect() == []


def test_a_tokenizer_that_keeps_blanks_encodes_whole_texts():
    whole = Vocabulary(default_path("byte_bpe_50k.json"))
    odd = ["a  b", " a", "", "x\n\ny"]
    assert not whole.by_word
    assert whole.encode([t.encode() for t in odd]) == [whole.raw(t) for t in odd]


def test_words_are_looked_up_once_and_encoded_together(voc):
    """Repeats of a word cost no lookup, words with marks or of other scripts no call each; ids are the library's."""
    class Lookups(dict):
        asked = 0

        def get(self, *key):
            Lookups.asked += 1
            return super().get(*key)

    class Calls:
        texts = 0

        def __getattr__(self, name):
            return getattr(voc.tok, name)

        def encode_batch_fast(self, texts, **kw):
            Calls.texts += len(texts)
            return voc.tok.encode_batch_fast(texts, **kw)

    v = Vocabulary(default_path())
    v.known, v.tok = Lookups(), Calls()
    odd = ["a\x01b \x01 c", "\u0301a b\u0301 e\u0301", "\ufffd z", " x\u00a0y\u2003 z\x1cq ", "\u0130st \u00df \u017f \u212b", "it's 's 12,3 ...",
           "a.b ,a !!", "<unk> </w>", "\u65e5\u672c \ud55c\uad6d \U0001f600!", "a\x00b word\n", ""]
    many = [" ".join(f"w{i}-{j}" for j in range(40)) for i in range(50)]
    got = v.encode([t.encode() for t in [*many, *many, *odd]] + [None])
    assert got == [np.asarray(ids_of(voc, t), dtype=v.dtype).tobytes() for t in [*many, *many, *odd, None]]
    assert Lookups.asked < 2200 and Calls.texts < 100


def test_counts_with_few_words_remembered(voc):
    few, texts_ = Vocabulary(default_path()), [prose(i, 40) for i in range(30)]
    few.remembered = 24
    for t in texts_:
        words = [w.encode() for w in dict.fromkeys(t.split())]
        assert few.counts(words).tolist() == [len(ids_of(voc, w.decode())) for w in words]
        assert len(few.known) <= 24
    assert few.counts([]).tolist() == []


def test_token_counts_of_a_tokenizer_that_keeps_blanks(spark, docs, empty):
    path = default_path("byte_bpe_50k.json")
    whole = Vocabulary(path)
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, tokenizer=path).collect())
    assert got == Counter((i, len((t or "").encode()), len(ids_of(whole, t))) for i, t in texts())
    assert token_counts.token_counts(empty, tokenizer=path).collect() == []


@pytest.mark.parametrize("pivots,group,block", [(64, 1024, 8192), (5, 3, 7), (1, 1, 1000)])
def test_top_k(spark, pivots, group, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(90)]
    rows += [(i, [0.5, -0.25, 0.1, 0.0, 0.0, 1.0]) for i in range(90, 200)]  # a third and more are the same vector
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (250, [0.3, 0.1]),
             (300, [1.0] * 6), (300, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(4)
    got = sorted(tuple(r) for r in topk_search.top_k(df, 5, F.col("vec_id") % 50 == 0, pivots=pivots, group=group,
                                                     block=block).select("query_id", "rank", "vec_id", "score").collect())
    kept = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept[i] = np.array([np.floor(256 * float(np.float32(x))) for x in [*v, *[0.0] * (6 - len(v))]]).astype(int)
    want = []
    for q in kept:
        if q % 50 == 0:
            best = sorted((-int(kept[q] @ x), i) for i, x in kept.items() if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(none, 5, F.col("vec_id") % 50 == 0).collect() == []
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert topk_search.top_k(few, 5, F.col("vec_id") == 0).count() == 2


@pytest.mark.parametrize("block_words,shard_words", [(1 << 16, 1 << 22), (40, 500)])
def test_mixing(docs, empty, block_words, shard_words):
    sized = docs.drop("size").withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))
    plan = lambda: mixing.plan(sized, block_words=block_words, shard_words=shard_words)
    rows = plan().select("doc_id", "source", "size", "source_size", "target", "draws").collect()
    assert len(rows) == len(texts())
    assert Counter(r["size"] for r in rows) == Counter(len(WORDS.findall(t or "")) for _, t in texts())
    words, taken, target = Counter(), Counter(), {}
    for r in rows:
        words[r["source"]] += r["size"]
        taken[r["source"]] += sum(d["words"] for d in r["draws"])
        target[r["source"]] = r["target"]
        assert sum(d["words"] for d in r["draws"]) <= 2 * r["size"]
    order = sorted((s for s in words if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(words.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        over = [s for s in free if left * weight[s] / sum(weight[f] for f in free) > 2 * words[s]]
        if not over:
            break
        fixed |= {s: 2.0 * words[s] for s in over}
    want = fixed | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 0.5
    assert sorted(map(str, rows)) == sorted(map(str, plan().select(
        "doc_id", "source", "size", "source_size", "target", "draws").collect()))
    out = mixing.emit(plan()).select("doc_id", "text", "source", "shard").collect()
    got = Counter()
    for r in out:
        got[r["source"]] += len(WORDS.findall(r["text"] or ""))
    assert got == +taken
    assert mixing.plan(empty.drop("size").withColumn("size", F.lit(0).cast("long"))).collect() == []


def test_splitting_tree_deals_every_draw_once_and_evenly():
    quotas = [0, 7, 500, 93, 1]
    tree = mixing.SplitTree(quotas, 13, 5)
    stratum = np.repeat(np.arange(5), quotas)
    place = np.concatenate([np.arange(q) for q in quotas])
    shard = tree.shard(stratum, place)
    assert np.ptp(np.bincount(shard, minlength=13)) <= 1
    mixed = np.random.default_rng(1).permutation(len(shard))
    assert (mixing.SplitTree(quotas, 13, 5).shard(stratum[mixed], place[mixed]) == shard[mixed]).all()


def junk(i: int) -> str:
    words = prose(i, 20).split()
    return " ".join(w.upper() + "!!" for w in words) if i % 2 else "### ".join(words)


def test_quality(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 120)
    rows = [(i, junk(i) if i % 3 == 0 else prose(i, 40)) for i in range(150)] + [(900, None), (901, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = [(i, 0 if i % 3 == 0 else 1) for i in range(150)] + [(0, 0), (None, 1), (5, None), (900, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    got = {r["doc_id"]: r["_s"] for r in quality.with_quality(table, labels, learn, out="_s").collect()}
    held = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in held]) >= 0.9
    assert len(got) == 152 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    none = labels.where("false")
    assert {r[0] for r in quality.with_quality(table, none, learn).select("score").collect()} == {0.5}
    assert quality.with_quality(empty, labels, learn).collect() == []
    odd = docs.select(quality.score(quality.start(), F.col("text"))).collect()
    assert len(odd) == len(texts())


def test_pooling_covers_the_whole_text(monkeypatch):
    net, text = quality.start(), prose(4, 300).encode()
    whole = quality.pooled(net, text)[0]
    monkeypatch.setattr(quality, "CHUNK", 64)
    assert np.allclose(quality.pooled(net, text)[0], whole, atol=1e-5)
    assert not np.allclose(quality.pooled(net, text[:-40] + b"\xff" * 40)[0], whole)


def test_repair_round_trip(docs, empty, voc):
    segments = repair.write(docs, segment=5000)
    assert segments.count() > 1
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"])
                  for r in repair.read(segments).collect()))
    rows = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for i, t in rows:
        ids = np.array([*ids_of(voc, t), 1], dtype="<u4")
        want.append((i is not None, i or 0, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert repair.read(repair.write(empty)).collect() == []


@pytest.mark.parametrize("base", [300, 60_000])
def test_repair_grammar(base):
    rng = np.random.default_rng(base)
    ids = np.concatenate([np.tile(rng.integers(0, base, 7), 400), rng.integers(0, 4, 5000), np.zeros(1000, dtype=int)])
    ends = np.array([1, 2, 1500, 1501, 5000, len(ids)])
    data = repair.compress(ids, ends, base)
    segment = repair.Segment(data, base)
    out, cut = segment.documents()
    assert (out == ids).all() and (cut == ends).all() and len(segment.rules) and len(data) < len(ids)
    starts = [0, *ends[:-1]]
    for d, (a, b) in enumerate(zip(starts, ends, strict=True)):
        for lo, hi in ((0, b - a), (1, 5), ((b - a) // 2, (b - a) // 2 + 3), (b - a - 1, b - a)):
            assert (segment.read_range(d, lo, hi) == ids[a + lo:min(a + hi, b)]).all()


def kept_hashes(text: str | None) -> list[int]:
    words = [w for w in WORDS.findall(text or "")]
    if not words:
        return []
    word = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    out = set()
    for i in range(max(1, len(word) - 4)):
        h = 42
        for w in word[i:i + 5]:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), seed=h)
        out.add(h >> 24)
    return sorted(h for h in out if h < 2**40 // sketch.FRACTION) or [min(out)]


def test_sketch(spark, docs, empty):
    rows = [(i, t) for i, t in texts() if i is not None and not (i == 10 and t is None)]
    rows = list({i: t for i, t in rows}.items())
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("next", F.lit(1)).repartition(5)
    got = {r["doc_id"]: r for r in sketch.edited(df).collect()}
    down = sorted(rows, reverse=True)
    assert len(got) == len(down)
    for (i, t), (_, n) in zip(down, down[1:] + down[:1], strict=True):
        t, n = t or "", n or ""
        changed = t[:len(t) - len(t) // 3] + n[:len(t) // 3]
        a, b, c = kept_hashes(t), kept_hashes(changed), kept_hashes(n)
        like = lambda x, y: 1.0 if x == y else len(set(x) & set(y)) / min(len(x), len(y)) if x and y else 0.0
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{h:010x}" for h in a)
        assert r["edited_fingerprint"] == "".join(f"{h:010x}" for h in b)
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, c))
    assert sketch.edited(docs).count() == len(texts()) and sketch.edited(empty).collect() == []
    alone = sketch.edited(df.where("doc_id = 9")).first()
    assert alone["near_next"] == 1.0


def test_packing(docs, empty, voc):
    rows = packing.pack_documents(docs, room=256).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of(voc, t)) + 1 for _, t in texts())
    want = Counter()
    for i, t in texts():
        ids = np.array([*ids_of(voc, t), 0], dtype="<u4")
        for p, a in enumerate(range(0, len(ids), 256)):
            want[i, p, a, len(ids[a:a + 256]), zlib.crc32(ids[a:a + 256].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1 + -(-sum(r["length"] for r in rows) // 256)
    assert packing.pack_documents(empty).collect() == []


def test_local_search_empties_sequences():
    lengths = np.array([6, 6, 6, 4, 4, 4, 5, 5, 10, 3, 3, 2, 2] * 30)
    bins = packing.Bins(lengths, 10)
    bins.bin, bins.fill = np.arange(len(lengths)), lengths.astype(np.int64).copy()  # one piece each to begin with
    bins.search()
    assert (np.bincount(bins.bin, lengths, len(bins.fill)) == bins.fill).all() and bins.fill.max() <= 10
    assert (bins.fill > 0).sum() <= bins.least + 2


def simhash_of(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints: list[int], radius: int) -> list[int]:
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_groups(docs, empty):
    named = docs.where("doc_id is not null").withColumn("fp", simhash.fingerprint(F.col("text"))[0])
    got = {(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.groups(named, "fp").collect()}
    rows = sorted((i, simhash_of(t)) for i, t in texts() if i is not None)
    roots = brute_components([p for _, p in rows], 3)
    assert got == {(i, p, rows[r][0]) for (i, p), r in zip(rows, roots, strict=True)}
    assert simhash.groups(empty.withColumn("fp", F.lit(0).cast("long")), "fp").collect() == []


@pytest.mark.parametrize("limit", [16384, 60, 4])
def test_links_of_crowded_chunks(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIMIT", limit)
    monkeypatch.setattr(simhash, "CHUNK", limit)
    rng = random.Random(limit)
    centre = [rng.getrandbits(64) for _ in range(60)]
    prints = set(centre)
    for c in centre:
        for _ in range(8):
            x = c
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(df, "fp").collect()}
    assert [got[i] for i in range(len(prints))] == brute_components(prints, 3)


def test_gray_index_levels():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([centre, *[centre ^ (np.uint64(1) << np.uint64(b)) for b in range(0, 60, 1)]]))
    assert len(x) > 2 * simhash.NODE**2 / 2
    a, b = simhash.GrayIndex(x[:, None], 3).run()
    roots = np.arange(len(x))
    roots[a] = b
    want = brute_components([int(v) for v in x], 3)
    assert len(set(zip(roots.tolist(), want, strict=True))) == len(set(want)) == len(set(roots.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(80)] + [(7, 7), (300, 301), (301, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in [100, *range(200, 280)]} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates(docs, empty):
    base = prose(77, 200).split()
    near = list(base)
    near[50] = "changed"
    far = [w if i % 4 else "other" + str(i) for i, w in enumerate(base)]
    more = docs.sparkSession.createDataFrame(
        [(500, " ".join(base)), (501, " ".join(near)), (502, " ".join(far)), (503, " ".join(base))], "doc_id long, text string")
    got = sorted(r["doc_id"] for r in simhash.without_near_duplicates(more).collect())
    assert got == [500, 502]
    kept = Counter(r["doc_id"] for r in simhash.without_near_duplicates(docs).collect())
    assert 6 in kept and 7 not in kept and 9 in kept and 10 not in kept and 1 in kept and 2 not in kept and 3 not in kept
    assert kept[None] == 1 and all(kept[100 + i] == 1 for i in range(60)) and max(kept.values()) == 1
    assert simhash.without_near_duplicates(empty).collect() == []


def planted_near(seed: int, n: int) -> list[tuple[int, str]]:
    """Texts and edits of them at similarities about 0.7 to 0.95: words changed here and there, parts appended, cut or replaced."""
    rng, rows = random.Random(seed), []
    for b in range(n):
        base = [w + str(rng.randrange(50)) for w in prose(seed * 1000 + b, 120 + b).split()]
        rows.append((len(rows), " ".join(base)))
        for alike in (0.7, 0.75, 0.79, 0.8, 0.82, 0.85, 0.9, 0.95):
            size = round(len(base) * (1 - alike) / (1 + alike))
            scattered, replaced, at = list(base), list(base), rng.randrange(len(base) - size)
            for k in range(max(1, size // 5)):
                scattered[rng.randrange(len(base))] = f"new{b}x{k}"
            replaced[at:at + size] = [f"other{b}y{k}" for k in range(size)]
            grown = base + [f"more{b}z{k}" for k in range(round(len(base) * (1 / alike - 1)))]
            rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate((scattered, replaced, grown, base[:round(len(base) * alike)]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("frequent", [3, 10**9])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    shared = prose(5, 60)  # a passage in many texts that are not copies
    rows = planted_near(3, 6) + [(1000 + i, f"{shared} {prose(9000 + i, 20 + i % 4)}") for i in range(40)]
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in simhash.without_near_duplicates(df).collect()}
    assert got == {find(i) for i in sets} and 40 < len(got) < len(rows) - 50


def test_a_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies with one to six edits of one text: those with few meet and are alike, those with more meet and are not."""
    rng = random.Random(8)
    base = [w + str(rng.randrange(50)) for w in prose(77, 150).split()]
    rows = [(0, " ".join(base))]
    for edits, copies in ((1, 60), (2, 60), (3, 30), (4, 30), (6, 30)):
        for _ in range(copies):
            copy = list(base)
            for k in range(edits):
                copy[rng.randrange(5, 145)] = f"new{len(rows)}x{k}"
            rows.append((len(rows), " ".join(copy)))
    met, real = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda d, name, **kw: met.append((name, (out := real(d, name, **kw)).count())) or out)
    got = {r["doc_id"] for r in simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(146)} for i, t in rows}
    alike = {(a, b) for a in sets for b in sets if a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    root, todo = dict.fromkeys(sets), set(sets)
    while todo:
        group = front = {min(todo)}
        while front:
            front = {b for a in front for b in todo - group if (a, b) in alike}
            group = group | front
        root.update(dict.fromkeys(group, min(group)))
        todo -= group
    assert got == set(root.values()) and 1 < len(got) < 100
    assert sum(n for name, n in met if name == "pairs") < 5 * len(rows) < len(alike) / 4


def test_near_duplicates_are_proposed_by_the_index(spark, monkeypatch):
    prints = [0, 0b111, 0b1111111, (1 << 63) - 1, 0]  # sets 10 and 14 have one fingerprint, 11 is near, 12 is near 11 only to four bits
    sets = spark.createDataFrame([(10 + i, p) for i, p in enumerate(prints)], "v long, fp long")
    assert {tuple(r) for r in simhash.proposed(sets).collect()} == {(10, 11), (10, 14)}
    seen = []
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda p, radius: seen.append(p.count()) or real(p, radius))
    rows = [(i, prose(i, 40)) for i in range(6)] + [(9, prose(3, 40) + " more")]
    got = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(6)) and seen and seen[0] >= 6


def test_batches_of_texts_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get(common.BATCH_CONF)
    got = [r["n"] for r in common.stored(spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long"), "sizes", texts=True).collect()]
    assert sum(got) == 3000 and max(got) <= common.BATCH_ROWS and spark.conf.get(common.BATCH_CONF) == before


def test_counts_bound_what_sets_share():
    rng = np.random.default_rng(5)
    for n, m, both in [(0, 0, 0), (1, 900, 1), (300, 310, 280), (40, 5000, 40), (700, 650, 0), (64, 64, 64)]:
        pool = rng.integers(0, 2**63, size=n + m, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:both], pool[n:n + m - both]])
        most, sizes = jaccard.shared_at_most(jaccard.counts_of(a), jaccard.counts_of(b))
        assert most >= both and sizes == n + m
        assert both or most < 0.75 * n or n < 100
    heavy = np.arange(300, dtype=np.uint64) << np.uint64(32)  # all in one bucket
    assert jaccard.counts_of(heavy) == b"" and jaccard.shared_at_most(b"", b"\1\0") == (0, 0)


def test_language(spark, docs, empty):
    rows = [(i, "the quick thing was here and there " * 3 if i % 2 else "der schnelle und das ist wirklich gut " * 3,
             "en" if i % 2 else "de") for i in range(40)] + [(41, "xx", None), (42, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(0))
    model = language.learn(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 . !"), (4, "das ist gut"), (5, "the thing was here"),
                                 (6, "the thing " * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["und", "und", "und", "de", "en", "en"]
    assert got[1][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    counts = Counter()
    for _, t, lang in rows:
        if lang and t:
            for h in language.ngrams(language.code_points(t)):
                counts.update((lang, int(x)) for x in h)
    total = sum(n for (lang, _), n in counts.items() if lang == "en") + language.FEATURES
    for (lang, h), n in counts.items():
        if lang == "en":
            assert model[1][h, 1] == pytest.approx(np.log((n + 1) / total), rel=1e-5)
    assert model[1][language.FEATURES] == pytest.approx(np.log([21 / 42, 21 / 42]), rel=1e-5)
    assert language.predict(docs, language.learn(docs)).count() == len(texts())
    # Predictions equal those of plain Python, on languages of unequal size and texts that are close calls.
    some = [(i, prose(i % 7, 30) if i % 5 else prose(i, 4), "ab"[i % 3 == 0]) for i in range(90)]
    few = spark.createDataFrame(some, "doc_id long, text string, lang string").repartition(4)
    seen, grams = Counter(lang for *_, lang in some), {lang: Counter() for lang in "ab"}
    for _, t, lang in some:
        for h in language.ngrams(language.code_points(t)):
            grams[lang].update(h.tolist())
    asked = [(i, prose(1000 + i, 1 + i % 6)) for i in range(60)]
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(asked, "doc_id long, text string"),
                                                    language.learn(few)).collect()}
    for i, t in asked:
        points = [int(x) for h in language.ngrams(language.code_points(t)) for x in h]
        log = {lang: np.log((seen[lang] + 1) / (len(some) + 2)) + sum(
            np.log((grams[lang][h] + 1) / (grams[lang].total() + language.FEATURES)) for h in points) for lang in "ab"}
        best = max(log, key=log.get)
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(np.exp(v - log[best]) for v in log.values()), rel=1e-3)
    nothing = language.learn(empty)
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}


def test_ngrams_of_slices(monkeypatch):
    points = language.code_points(prose(8, 100))
    whole = Counter(int(x) for h in language.ngrams(points) for x in h)
    monkeypatch.setattr(language, "SLICE", 37)
    assert Counter(int(x) for h in language.ngrams(points) for x in h) == whole


def brute_repeats(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        units = substring.UNIT.findall(t or "")
        flags, at, spans = [], 0, []
        for u in units:
            key = tuple(w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORDS.findall(u))
            flags.append(bool(key) and key in seen or (not key and bool(flags) and flags[-1]))
            seen.add(key)
        kept, j = "", 0
        while j < len(units):
            k = j
            while k < len(units) and flags[k]:
                k += 1
            n = sum(len(WORDS.findall(u)) for u in units[j:k])
            end = at + sum(map(len, units[j:k]))
            if k > j and n >= 10:
                spans.append(f"{at}-{end}")
            else:
                kept += "".join(units[j:k])
            at = end
            if k < len(units):
                kept += units[k]
                at += len(units[k])
            j = k + 1
        out[i] = (None if t is None else kept, ",".join(spans))
    return out


def test_substring(spark, docs, empty):
    rows = list({i: t for i, t in texts() if i is not None}.items())
    passage = prose(31, 70).replace(",", "") + "."
    rows += [(700 + i, f"{prose(600 + i, 9)}. {passage} {prose(700 + i, 9)}.\n\n Yes. No. {prose(800 + i, 12)}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).repartition(4)
    got = {r["doc_id"]: (r["kept_text"], r["removed"]) for r in substring.without_repeats(df).collect()}
    assert got == brute_repeats(rows)
    assert passage in got[700][0] and all(passage[20:60] not in got[700 + i][0] for i in range(1, 5))
    for i, t in rows:
        if t is not None:
            cut = [tuple(map(int, s.split("-"))) for s in got[i][1].split(",") if s]
            left = "".join(c for n, c in enumerate(t) if not any(a <= n < b for a, b in cut)) if len(t) < 50_000 else got[i][0]
            assert left == got[i][0]
    assert substring.without_repeats(docs).count() == len(texts())
    assert substring.without_repeats(empty).collect() == []


def test_substring_of_rows_without_or_with_one_id(spark):
    passage, other = prose(41, 30).replace(",", "").replace(".", "") + ".", prose(42, 30).replace(".", "") + "."
    alone = [prose(50 + i, 25).replace(".", "") + "." for i in range(9)]
    rows = [(1, f"{passage} {alone[0]}"), (None, f"{alone[1]} {passage} {alone[2]}"), (None, f"{passage} {alone[3]}"),
            (None, f"{alone[4]} {other}"), (None, f"{alone[5]} {other}"), (7, f"{alone[6]} {alone[7]}"),
            (7, f"{alone[8]} {passage}"), (9, f"{alone[0]} x"), (9, f"{alone[0]} x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # numbered in this order
    want = brute_repeats([((i is None, i or 0, n), t) for n, (i, t) in enumerate(rows)])
    got = Counter((r["doc_id"], r["text"], r["kept_text"], r["removed"]) for r in substring.without_repeats(df).collect())
    assert got == Counter((k[1] or None, rows[k[2]][1], *v) for k, v in want.items())


def test_pipeline_on_odd_rows(spark, docs, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 20)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(100, 160)] + [(4, 0), (5, 0)], "doc_id long, quality int").write.parquet(
        str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == before.columns
            assert [tuple(r) for r in now.select(*CLASH).distinct().collect()] == [tuple(range(len(CLASH)))]
            now = spark.createDataFrame(now.collect(), now.schema)
    assert now.count() > 0
    nothing = empty
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path))
    assert nothing.collect() == []
