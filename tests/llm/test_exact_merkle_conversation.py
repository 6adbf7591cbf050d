"""Exact duplicates, Merkle proofs and repaired conversations against plain Python, on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfproof.llm import conversation, exact, merkle
from shelfproof.llm.conversation import ADJACENT, BLOCK, INITIALS, KEPT, Tables, WRITTEN

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Further columns of the input with the names that the operators use inside.
CLASH = ("id", "row", "digest", "best", "size", "g", "n", "idx", "children", "path", "kept",
         "keep_id", "leaf", "root", "conv", "pos", "edits", "tail", "h", "_n")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def documents() -> list[tuple]:
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "B", "ü", "a b", "A B"]), rng.choice([None, "en", "de", "é"]), rng.choice([None, "s"]), i)
            for i in range(150)]
    rows += [(1000 + i, "Hot Text", "en", "s", None) for i in range(300)]  # two thirds share a text
    rows += [(7, None, None, None, None), (8, "", "xx", "", 0), (None, "Hot text", "en", None, 1), (None, None, None, None, None),
             (None, "only here", None, "s", 9), (None, "only here", None, "s", 9), (5000, "Wörd " * 60_000, "yy", "s", 1)]
    return rows + [(9, "twice", "en", "s", 3)] * 40 + [(9, "other", "en", "s", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit('x') for c in CLASH}).repartition(5)


@pytest.mark.parametrize("share", [1024, 8, 2])
def test_exact_groups(docs, share):
    got = [tuple(r) for r in exact.groups(docs, share=share).collect()]
    groups = defaultdict(list)
    for i, t, *_ in documents():
        groups[sha((t or "").translate(LOW).encode())].append(i)
    want = Counter()
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), digest) for i in ids)
    assert Counter((i, keep, n, d) for i, keep, n, _, d in got) == want
    kept = [(i, d) for i, keep, _, k, d in got if k]
    assert sorted(d for _, d in kept) == sorted(groups)
    assert all(i == keep for i, keep, _, k, _ in got if k)


def test_exact_groups_of_nothing(spark, docs):
    assert exact.groups(docs.limit(0)).collect() == []


def test_frequent_digests_are_all_found(spark):
    rng = random.Random(8)
    for share in (2, 5, 20):
        keys = [bytes([rng.randrange(int(rng.choice([3, 30, 250])))]) for _ in range(4000)]
        df = spark.createDataFrame([(bytearray(k),) for k in keys], "digest binary").repartition(7)
        found = {bytes(r.digest) for r in exact.frequent(df, share).collect()}
        assert {k for k, n in Counter(keys).items() if n > len(keys) / share} <= found
        assert len(found) < 2 * share


def test_merged_counters_keep_their_bound():
    rng = random.Random(1)
    seen, held = Counter(), {}
    for _ in range(60):
        new = Counter(rng.choices(range(200), weights=[1 / (1 + k) for k in range(200)], k=100))
        seen += new
        held = exact.merged(held, {k: n for k, n in new.items()}, 20)
        assert len(held) <= 20
    assert all(seen[k] - sum(seen.values()) / 21 <= held.get(k, 0) <= seen[k] for k in seen)


def encoded(*fields) -> bytes:
    return b"".join(b"-" if f is None else b"%d:%s" % (len(str(f).encode()), str(f).encode()) for f in fields)


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i:i + 8]).encode()) for i in range(0, len(now), 8)])
    return levels


def way(levels: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
    steps = []
    for level in levels[:-1]:
        lo = at // 8 * 8
        steps.append((level[lo:at], level[at + 1:lo + 8]))
        at //= 8
    return steps


def manifest_of(rows: list[tuple]) -> Counter:
    """doc_id, leaf, subroot, root, proof, folded root of rows ``(doc_id, text, lang, source, n_chars)``."""
    by_lang = defaultdict(list)
    for i, text, lang, source, n in rows:
        low = text.translate(LOW) if text is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else text
        by_lang[lang].append(((i is not None, i or 0), sha(encoded(i, source, lang, n, text)), i,
                              sha(encoded(i, source, lang, n, low))))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: r[:2])
        trees[lang] = tree([r[1] for r in by_lang[lang]])
    over = tree([trees[lang][-1][0] for lang in langs])
    out = Counter()
    for g, lang in enumerate(langs):
        for at, (_, leaf, i, shown) in enumerate(by_lang[lang]):
            steps = way(trees[lang], at) + way(over, g)
            now = shown
            for left, right in steps:
                now = sha("".join([*left, now, *right]).encode())
            out[i, leaf, trees[lang][-1][0], over[-1][0], sha("".join(x for s in steps for p in s for x in p).encode()), now] += 1
    return out


def shown_manifest(df):
    kept = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf, low = (merkle.leaf([*kept, t]) for t in (F.col("text"), F.translate("text", *map("".join, (
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))))
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, low).otherwise(leaf)
    made = merkle.manifest(df, F.col("lang"), F.col("doc_id"), leaf, shown)
    proof = merkle.joined(merkle.siblings(F.col("proof")))
    return made.select("id", *[merkle.text_of(c).alias(n) for n, c in (
        ("leaf", F.col("leaf")), ("subroot", F.col("subroot")), ("root", F.col("root")), ("proof", proof),
        ("folded", merkle.folded(F.col("shown"), F.col("proof"))))])


def test_manifest(docs):
    assert Counter(tuple(r) for r in shown_manifest(docs).collect()) == manifest_of(documents())


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 1], [1] * 9, [64, 65, 1, 8], [520]])
def test_manifest_of_sizes(spark, sizes):
    rows = [(i, f"T{i}", f"l{g:02}", "s", i) for g, n in enumerate(sizes) for i in range(g * 1000, g * 1000 + n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in shown_manifest(df).collect()]
    assert Counter(got) == manifest_of(rows)


def test_manifest_of_nothing(docs):
    assert shown_manifest(docs.limit(0)).collect() == []


WORD = re.compile(r"[^\x20\x09-\x0D]")
ROLE = {"s": "system", "u": "user", "a": "assistant"}


def cheapest(rows: list[tuple[str, str, bool, bool]]) -> tuple[int, str, list[str]]:
    """Cost, letters and lines of rows (role, text, must go, cut off), by trying every prefix and state in order of cost."""
    best = {(0, 0): (0, "", ())}
    for cost in range(0, 4 * len(rows) + 1):
        for at in range(len(rows) + 1):
            for _ in range(3):  # inserts at one place
                for state in range(4):
                    now = best.get((at, state))
                    if now is None or now[0] != cost:
                        continue
                    ways = [(at, WRITTEN[state], 3, "I", (f"{['', '', 'user', 'assistant'][WRITTEN[state]]}:",))]
                    if at < len(rows):
                        role, text, gone, cut = rows[at]
                        ways.append((at + 1, state, 4, "D", ()))
                        if not gone:
                            to = KEPT.get((role[:1], state))
                            if to is not None:
                                ways.append((at + 1, to, 3 * cut, "K", (f"{role}:{text}",)))
                            to = WRITTEN[state]
                            ways.append((at + 1, to, 3 + 3 * cut, "R", (f"{['', '', 'user', 'assistant'][to]}:{text}",)))
                    for i, q, c, letter, line in ways:
                        new = (cost + c, now[1] + letter, now[2] + line)
                        if (i, q) not in best or new < best[i, q]:
                            best[i, q] = new
    cost, letters, lines = min(best[len(rows), q] for q in (0, 3) if (len(rows), q) in best)
    return cost, letters, list(lines)


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def summary_of(rows: list[tuple], originals: list) -> dict:
    by = {c: [] for c in originals}
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        seen, marked, count = set(), [], Counter()
        for *_, role, _, text in turns:
            blank = not WORD.search(text)
            again = not blank and (role, text) in seen
            cut = not blank and not again and WORD.findall(text)[-1] not in ".!?"
            seen.add((role, text))
            marked.append((role, text, blank or again, cut))
            count.update({"blank": blank, "again": again, "cut": cut})
        known = {t[1] for t in turns if t[0]}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ADJACENT for a, b in itertools.pairwise(marked))
        cost, letters, lines = cheapest(marked)
        out[conv] = (gaps, count["blank"], count["again"], count["cut"], illegal, cost, letters,
                     sha("\n".join(lines).encode()))
    return out


def turns_of() -> list[tuple]:
    rng = random.Random(6)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Ünknown", "sys"]
    texts = ["Yes.", "No", "Why?", " \t", "", None, "Ok! \n", "ünd.", "日本", "a b"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), rng.choice(roles), rng.choice(texts)))
    for turn in range(120):  # long conversations
        rows.append((100, turn, rng.choice(roles[:5]), f"{rng.choice(texts)} {turn}."))
        rows.append((None, turn // 7, rng.choice(roles), rng.choice(texts)))
    rows += [(200, 3, "user", "Again.")] * 90 + [(201, None, None, None)] * 3 + [(202, 1, "user", "word " * 50_000)]
    rows += [(203, t, "user", "x") for t in range(400) if zlib.crc32(f"203:{t}".encode()) % 20 == 0]  # all dropped
    return rows


@pytest.mark.parametrize("segment", [1, 5, 4096])
def test_conversations(spark, segment):
    rows = turns_of()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit('x') for c in CLASH}).repartition(4)
    made = conversation.repair(conversation.damage(df), segment=segment)
    got = {r[0]: tuple(r)[1:] for r in conversation.summary(df, made).collect()}
    want = summary_of(damaged(rows), [r[0] for r in rows])
    assert got == want
    assert any(set("DIKR") <= set(w[6]) for w in want.values())


def test_repaired_lines_read_the_pattern(spark):
    df = spark.createDataFrame(turns_of(), "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for r in conversation.repair(df).lines.where(F.col("role").isNotNull()).collect():
        by[r.conv].append((r.pos, r.step, r.role[:1]))
    assert by
    for turns in by.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(t[2] for t in sorted(turns)))


def test_conversations_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation.summary(none, conversation.repair(conversation.damage(none))).collect() == []


def test_turns_far_apart(spark):
    df = spark.createDataFrame([(1, -2**63, "user", "A."), (1, 2**63 - 1, "assistant", "B.")],
                               "conv_id long, turn long, role string, text string")
    row = conversation.summary(df, conversation.repair(df)).first()
    assert row.gaps is None and row.audit == "KK"


def test_block_tables_equal_single_steps():
    table = Tables(BLOCK)
    rng = np.random.default_rng(2)
    for _ in range(60):
        symbols = rng.integers(0, 9, size=rng.integers(1, 30))
        front, added, state = table.transition(symbols)
        for v in range(len(table.vectors)):
            costs = table.vectors[v]
            for s in symbols[::-1]:
                costs = table.before(costs, int(s))
            assert min(costs) == added[v] and tuple(c - min(costs) for c in costs) == table.vectors[front[v]]
        v, q = int(rng.integers(len(table.vectors))), int(rng.integers(4))
        letters = table.letters(symbols, v, q, False)
        assert len(letters) == len(symbols)
        for s, part in zip(symbols.tolist(), letters, strict=True):
            for letter in part:
                q = q if letter == "D" else KEPT[INITIALS[s % 4], q] if letter == "K" else WRITTEN[q]
        assert q in state[v]
