"""Training-data operators over whole tables: mixing, line dedup, near copies, fingerprints, toxicity, the pipeline."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridsmith.llm import fingerprints, linededup, mixing, neardup, toxicity
from gridsmith.llm.components import components
from gridsmith.llm.omh import Shingler, Sketcher, likeness
from gridsmith.llm.scratch import Scratch

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """(doc_id, text, source) rows as documents, in several partitions."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA).repartition(3)


def words(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def prose(rng, n):
    """Words without digits."""
    return " ".join("".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(n))


# Mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    return target


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.choice([1, 5, 40, 900])), rng.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "b"), (None, "one two", "b"), (7, "again and again", "z"), (7, "again and again", "z"), (1002, "  \x0b x", "only")]
    return rows


def brute_mix(rows):
    """(doc_id, source, size, words taken in each pass) of each row: all packets in one list, sorted and cut."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = Counter()
    for n, (_, _, s) in zip(size, rows, strict=True):
        total[s] += n
    target = brute_targets(dict(total))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    key = [md5((str(i) if i is not None else "null" + md5(t or "")) + f"-{mixing.SEED}") for i, t, _ in rows]
    packets = []
    for s in total:
        ahead = 0
        for p in range(mixing.CAP):
            for r in sorted((r for r in range(len(rows)) if rows[r][2] == s), key=lambda r: (key[r], size[r])):
                for at in range(0, size[r], mixing.PACKET):
                    words = min(mixing.PACKET, size[r] - at)
                    packets.append(((ahead + at + words) / target[s], key[r], size[r], s is None, s or "", p, ahead, r, words))
                ahead += size[r]
    left, taken = int(1.5 * sum(size)), [[0] * mixing.CAP for _ in rows]
    for *_, p, _, r, words in sorted(packets):
        taken[r][p] += min(words, left)
        left -= min(words, left)
    return [(i, s, n, *t) for (i, _, s), n, t in zip(rows, size, taken, strict=True)], target


@pytest.mark.parametrize("small", [mixing.SORTED, 3])
def test_mixing_against_brute_force(spark, mixed, monkeypatch, small):
    monkeypatch.setattr(mixing, "SORTED", small)
    want, target = brute_mix(mixed)
    docs = frame(spark, mixed)
    out = mixing.served(mixing.sizes_of(docs), Scratch(spark)).collect()
    text = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert text((r["doc_id"], r["source"], r["size"], r["taken0"], r["taken1"]) for r in out) == text(want)
    got = Counter()
    for r in out:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["taken0"] + r["taken1"] <= 2 * r["size"]
        got[r["source"]] += r["taken0"] + r["taken1"]
    assert all(abs(n - target[s]) <= mixing.PACKET for s, n in got.items())
    again = mixing.served(mixing.sizes_of(docs.repartition(5)), Scratch(spark)).collect()
    assert text(again) == text(out)


def test_mixture_takes_whole_documents(spark, mixed):
    docs = frame(spark, mixed)
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    want = Counter()
    for (i, t, _), (_, _, n, *taken) in zip(mixed, brute_mix(mixed)[0], strict=True):
        want[i, t] += sum(n > 0 and 2 * w >= n for w in taken)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == +want
    assert Counter((r["doc_id"], r["text"]) for r in mixing.mixture(docs, ordered=True).collect()) == +want


def test_equal_rows_are_taken_one_by_one(spark):
    rows = [(5, "eight words are in each of these rows", "c")] * 100 + [(i, "w " * 50, "ab"[i % 2]) for i in range(40)] + [(None, f"no id {i}", "b") for i in range(30)]
    out = mixing.mixture(frame(spark, rows)).collect()
    want, target = brute_mix(rows)
    got = Counter()
    for r in out:
        got[r["source"]] += len(r["text"].split())
    assert all(abs(got[s] - target[s]) <= 50 for s in "ab") and abs(got["c"] - target["c"]) <= 8
    assert sum(r["source"] == "c" for r in out) == sum(2 * w >= n for _, s, n, *taken in want if s == "c" for w in taken)


def test_mixing_of_empty_tables(spark):
    docs = frame(spark, [(1, "", "a"), (2, None, None)])
    out = mixing.served(mixing.sizes_of(docs), Scratch(spark)).collect()
    assert [(r["taken0"], r["taken1"], r["target"]) for r in out] == [(0, 0, 0.0)] * 2
    assert mixing.served(mixing.sizes_of(docs.limit(0)), Scratch(spark)).count() == 0 and mixing.mixture(docs.limit(0)).count() == 0


# Line dedup


def brute_lines(rows, long_docs=linededup.LONG_DOCS):
    """(doc_id, text, lines, dropped) by the statement of the module, each row a document."""
    place = [(linededup.LAST if i is None else i, int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)) for i, t, _ in rows]
    enough = lambda n: long_docs if n > linededup.LONG_TOKENS else linededup.LEAST_DOCS
    exact = defaultdict(set)  # template: its rows
    for r, (_, t, _) in enumerate(rows):
        for line in (t or "").split("\n"):
            if tokens := tuple(linededup.masked(line)):
                exact[tokens].add(r)
    recurs = {t for t, rs in exact.items() if len(rs) >= enough(len(t))}
    leaves = defaultdict(list)
    for t in exact:
        if len(t) >= linededup.LEAST_GENERAL:
            leaves[len(t), t[: linededup.LEAD]].append(t)
    general, members = {}, defaultdict(set)
    for (n, _), ts in leaves.items():
        have = Counter((p, x) for t in ts for p, x in enumerate(t) if x != linededup.ANY)
        for t in ts:
            kept = tuple((p, x) for p, x in enumerate(t) if have[p, x] >= max(linededup.LEAST_DOCS, len(ts) * linededup.FIXED_SHARE))
            if len(kept) >= linededup.LEAST_FIXED and len(kept) >= n * linededup.GENERAL_SHARE:
                general[t] = (n, kept)
                members[n, kept] |= exact[t]
    first = {t: min(place[r] for r in exact[t]) for t in recurs}
    for t, g in general.items():
        if t not in recurs and len(members[g]) >= enough(len(t)):
            first[t] = min(place[r] for r in members[g])
    out = []
    for r, (i, t, _) in enumerate(rows):
        lines = t.split("\n") if t else []
        kept = [x for x in lines if first.get(tuple(linededup.masked(x)), place[r]) == place[r]]
        out.append((i, "\n".join(kept) if t else t, len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    boiler = ["All rights are reserved by us", "Page 12 of 90 printed here today", prose(rng, 60), prose(rng, 14)]
    rows = []
    for i in range(60):
        lines = [prose(rng, rng.choice([2, 8, 30])) for _ in range(4)]
        if rng.random() < 0.5:
            pick = rng.choice(boiler)
            lines.insert(rng.randrange(5), re.sub(r"\d+", lambda m: str(rng.randrange(99)), pick) if "Page" in pick else pick)
        if i % 7 == 0:  # a varied field of a long line
            field = boiler[3].split()
            field[-1] = prose(rng, 1)
            lines.append(" ".join(field))
        rows.append((i, "\n".join(lines), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (None, boiler[0] + "\nmy own line of text", "s"), (102, boiler[2] + "\n" + boiler[2], "s"), (103, "\n\n", "s"), (104, "a b " * 20_000, "s")]
    out = linededup.drop_lines(frame(spark, rows), counts=True)
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "n_lines", "n_dropped"]
    got = sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect())
    assert got == sorted((str(i), t, n, d) for i, t, n, d in brute_lines(rows))
    assert sum(d for *_, d in got) > 20
    assert linededup.drop_lines(frame(spark, rows).limit(0)).count() == 0


def test_passages_go_from_all_but_the_first(spark):
    rng = random.Random(9)
    passage = prose(rng, 70)
    rows = [(i, f"{prose(rng, 20)}\n{passage}\n{prose(rng, 20)}", "s") for i in range(5)]
    out = {r["doc_id"]: r["text"] for r in linededup.drop_lines(frame(spark, rows)).collect()}
    assert [i for i, t in out.items() if passage in t] == [0]
    assert all(len(t.split()) == 40 for i, t in out.items() if i)


def test_two_documents_suffice_for_long_passages(spark):
    rng = random.Random(11)
    passage, short = prose(rng, 51), prose(rng, 50)
    rows = [(i, f"{prose(rng, 20)}\n{passage}\n{short}", "s") for i in range(2)]
    out = {r["doc_id"]: r["text"] for r in linededup.drop_lines(frame(spark, rows)).collect()}
    assert passage in out[0] and passage not in out[1]
    assert short in out[0] and short in out[1]
    assert all(passage in r["text"] for r in linededup.drop_lines(frame(spark, rows), long_docs=3).collect())


@pytest.mark.parametrize("small", [0, linededup.SMALL_LEAVES])
def test_variable_fields_are_generalised(spark, monkeypatch, small):
    monkeypatch.setattr(linededup, "SMALL_LEAVES", small)
    rng = random.Random(21)
    who, where = [prose(rng, 1) for _ in range(40)], [prose(rng, 1) for _ in range(40)]
    long = prose(rng, 30).split()
    varied = lambda: " ".join(x if k not in (4, 11, 12, 26) else prose(rng, 1) for k, x in enumerate(long))
    rows = [(i, f"{prose(rng, 12)}\nPosted by {who[i]} in {where[i]}\n{varied()}", "s") for i in range(40)]
    rows += [(100 + i, f"Posted by nobody in particular {i}\nPosted by {prose(rng, 3)}", "s") for i in range(6)]  # the same leaf, and less alike
    rows += [(200, "Posted by one two three", "s"), (None, "Posted by no in body", "s"), (7, rows[7][1], "s")]
    out = linededup.drop_lines(frame(spark, rows), counts=True).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in out) == sorted((str(i), t, n, d) for i, t, n, d in brute_lines(rows))
    by = {r["doc_id"]: r["n_dropped"] for r in out}
    assert by[0] == 0 and all(by[i] == 2 for i in range(1, 40)) and by[200] == 0 and by[None] == 1


def test_no_line_that_recurs_word_for_word_goes_from_everywhere(spark):
    rng = random.Random(29)
    base = prose(rng, 20).split()
    other = " ".join(base[:-1] + [prose(rng, 1)])
    rows = [(1, other, "s")] + [(i, " ".join(base), "s") for i in (2, 3, 4)] + [(5, " ".join(base[:-1] + [prose(rng, 1)]), "s")]
    out = {r["doc_id"]: r["text"] for r in linededup.drop_lines(frame(spark, rows)).collect()}
    assert out == {1: other, 2: " ".join(base), 3: "", 4: "", 5: ""}


def test_rows_with_null_or_repeated_ids_are_documents_of_their_own(spark):
    rng = random.Random(13)
    a, b, c = (prose(rng, 12) for _ in range(3))
    own = [prose(rng, 20) for _ in range(12)]
    rows = [(None, f"{own[i]}\n{a}", "s") for i in range(4)]  # only among rows without an id
    rows += [(7, f"{own[4 + i]}\n{b}", "s") for i in range(4)]  # only among rows that repeat one
    rows += [(i, f"{own[8 + j]}\n{c}", "s") for j, i in enumerate([None, None, 9, 8])]
    out = [(r["doc_id"], r["text"]) for r in linededup.drop_lines(frame(spark, rows)).collect()]
    assert sorted(map(str, out)) == sorted(str(x[:2]) for x in brute_lines(rows))
    assert len(out) == len(rows) and all(sum(o in t for _, t in out) == 1 for o in own)
    assert [i for i, t in out if a in t] == [None] and [i for i, t in out if b in t] == [7] and [i for i, t in out if c in t] == [8]


def test_templates():
    assert linededup.masked("a b") == [] and linededup.masked("1 2 3 4") == []
    assert linededup.masked("took 15ms to\tload") == linededup.masked("  took 9ms to load ") == ["took", "<*>", "to", "load"]
    a, b = (linededup.masked(f"{x} one two three four five") for x in ("k1", "k2"))
    assert linededup.key(a) == linededup.key(b) and linededup.leaf(a) == linededup.leaf(b) != linededup.leaf(a[:-1])
    assert linededup.leaf(["a", "b", "c", "d"]) == linededup.NONE and linededup.key(["x"] * 51) & 1 and not linededup.key(["x"] * 50) & 1


# Sketches and near copies


def test_sketches_follow_order_and_edits():
    rng = random.Random(1)
    shingle, sketch = Shingler(), Sketcher(256, 2)
    text = words(rng, 300, 10**6).split()
    a = sketch(shingle(" ".join(text)))
    near = text[:150] + ["changed"] + text[151:]
    moved = text[150:] + text[:150]
    assert (sketch(shingle(" ".join(text))) == a).all()
    close, swapped = likeness(a, sketch(shingle(" ".join(near)))), likeness(a, sketch(shingle(" ".join(moved))))
    assert close > 0.85 and swapped < 0.65  # the same k-mers, but pairs across the cut change their order
    assert likeness(a, sketch(shingle(words(rng, 300, 10**6)))) == 0
    twice = shingle("a b c d e a b c d e a b c d e")
    assert len(set(twice.tolist())) == twice.size  # repeats are told apart
    assert not sketch(shingle("")).any() and shingle("one two").size == 1


def test_sketches_of_long_texts_equal_those_in_one_block(monkeypatch):
    import gridsmith.llm.omh as omh

    labelled = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    want = Sketcher(16, 3)(labelled)
    monkeypatch.setattr(omh, "BLOCK", 64)
    assert (Sketcher(16, 3)(labelled) == want).all()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_against_dynamic_programming():
    rng = random.Random(4)
    for _ in range(200):
        a = rng.sample(range(80), rng.randrange(1, 40))
        b = list(a)
        for _ in range(rng.randrange(6)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randrange(len(b) + 1), rng.randrange(100, 10**6))
        b = list(dict.fromkeys(b))
        if not b:
            continue
        n = lcs(a, b)
        want, got = n / (len(a) + len(b) - n), neardup.alignment(np.array(a, "<u4"), np.array(b, "<u4"))
        assert got == pytest.approx(want) if want >= 0.6 else got >= want - 1e-9


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, monkeypatch, small):
    import gridsmith.llm.components as module

    monkeypatch.setattr(module, "SMALL_LINKS", small)
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(400):03d}", f"n{rng.randrange(400):03d}") for _ in range(260)] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(350, 399)] + [("n001", "n001")]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark)).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a string, b string"), Scratch(spark)).count() == 0


def edited(rng, text, n):
    out = text.split()
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(8)
    rows = []
    for g in range(8):
        base = words(rng, rng.choice([30, 120, 400]), 10**6)
        rows += [(len(rows) + k, edited(rng, base, k % 4) if k else base, "s") for k in range(rng.choice([2, 3, 9]))]
        rows += [(len(rows), base, "s")] * (g % 3)
    passage = words(rng, 80, 10**6)
    rows += [(1000 + i, passage + " " + words(rng, 10 + i % 40, 10**6), "s") for i in range(150)]  # one common passage
    big = words(rng, 150, 10**6)
    rows += [(2000 + i, edited(rng, big, rng.randrange(1, 5)), "s") for i in range(120)]  # one large group
    rows += [(3000, None, "s"), (3001, "", "s"), (3002, "...", "s"), (3003, "two words", "s"), (3004, "Two, words!", "s"), (None, "a null id here with words", "s"), (3005, "z " * 30_000, "s"), (3006, "z " * 30_000, "s")]
    return rows


def brute_classes(rows):
    """Components of all pairs of texts whose aligned labelled shingles are alike by 0.8."""
    texts = sorted({t or "" for _, t, _ in rows})
    shingle = Shingler()
    seqs = [(shingle(t) >> np.uint64(32)).astype("<u4") for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(seqs):
        for v in set(s.tolist()):
            holders[v].append(i)
    common = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    for (a, b), n in common.items():
        if n / (seqs[a].size + seqs[b].size - n) >= 0.8 and neardup.alignment(seqs[a], seqs[b]) >= 0.8:
            root[find(a)] = find(b)
    groups = defaultdict(set)
    for i, t in enumerate(texts):
        groups[find(i)].add(t)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("small_bucket", [neardup.SMALL_BUCKET, 2, 10**6])
def test_near_copies_against_all_pairs(spark, copies, monkeypatch, small_bucket):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small_bucket)
    got = neardup.near_copies(frame(spark, copies)).collect()
    text_of = {hashlib.md5((t or "").encode()).hexdigest(): t or "" for _, t, _ in copies}
    groups = defaultdict(set)
    for r in got:
        groups[r["root"]].add(text_of[r["digest"]])
    assert {frozenset(g) for g in groups.values()} == brute_classes(copies)
    assert sum(r["n"] for r in got) == len(copies)


def test_short_near_copies_all_meet(spark):
    rng = random.Random(17)
    short = [prose(rng, 8) for _ in range(1500)]
    rows = [(2 * i + j, t + " dada" * j, "s") for i, t in enumerate(short) for j in range(2)]  # 4 and 5 shingles, alike by 0.8
    got = {r["doc_id"]: r["class_id"] for r in neardup.classify(frame(spark, rows)).collect()}
    assert [i for i in got if got[i] != i - i % 2] == []


def test_one_large_group_costs_a_few_rows_a_member(spark):
    """Near copies of a text, and texts that are just too far from all of them: the rows that meet follow strays and members, not shingles or pairs."""
    rng = random.Random(19)
    base = words(rng, 150, 10**6)
    far = {i for i in range(1, 800) if i % 50 == 0}
    rows = [(i, edited(rng, base, 6 if i in far else 1 + i % 3) if i else base, "s") for i in range(800)]
    scratch, made = Scratch(spark), Counter()
    keep = scratch.keep

    def counted(df):
        out = keep(df)
        made[tuple(out.columns)] = max(made[tuple(out.columns)], out.count())
        return out

    scratch.keep = counted
    root = {r["doc_id"]: r["root"] for r in neardup.near_copies(frame(spark, rows), scratch=scratch).collect()}
    assert {i for i in root if root[i] == root[0]} == set(root) - far
    assert made["a", "na", "rb"] <= len(far) ** 2 and made["a", "b"] <= (24 + len(far)) * len(rows)


def test_columns_of_clashing_names_stay(spark):
    """Columns named like the operators' own helpers keep their values."""
    rng = random.Random(23)
    base = [prose(rng, 40) for _ in range(4)]
    names = "_id _gone n_lines n_dropped _source cut0 _mine stays _d _least digest _digest text_digest least key finish before root rank size".split()
    rows = [(i, f"{base[i % 4]}\n{base[0]} end {i}", "s", *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    for made in (neardup.keep_one(docs), linededup.drop_lines(docs), mixing.mixture(docs)):
        assert made.columns == docs.columns
        out = made.collect()
        assert out and all(r[n] == f"{n}{r['doc_id']}" for r in out for n in names)
    with pytest.raises(ValueError, match="n_lines"):
        linededup.drop_lines(docs, counts=True)


def test_classes_and_survivors(spark, copies, monkeypatch):
    docs = frame(spark, copies)
    rows = neardup.classify(docs).collect()
    assert len(rows) == len(copies)
    of = {r["doc_id"]: r["class_id"] for r in rows}
    for g in brute_classes(copies):
        ids = {i for i, t, _ in copies if (t or "") in g and i is not None}
        assert {of[i] for i in ids} == ({min(ids)} if ids else set())
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(min((i for i, t, _ in copies if (t or "") in g), key=lambda i: (i is None, i or 0))) for g in brute_classes(copies))
    monkeypatch.setattr(neardup, "SMALL_IDS", 0)  # the way without broadcasts
    assert sorted(map(str, neardup.keep_one(docs).collect())) == sorted(map(str, kept.collect()))
    assert neardup.classify(docs.limit(0)).count() == 0 and neardup.keep_one(docs.limit(0)).count() == 0


# Fingerprints


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.choice([0, 1, 9, 200])), "s") for i in rng.sample(range(10**6), 60)]
    rows += [(5, "é" * 999, "s"), (5, "é" * 999, "s"), (5, "tie", "s"), (6, None, "s"), (None, "no id", "s"), (None, None, "s"), (9, "long " * 20_000, "s")]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).digest()))
    shingle, sketch = Shingler(), Sketcher(fingerprints.M, fingerprints.ELL)
    print_ = lambda t: fingerprints.printed(sketch(shingle(t)))
    want = []
    for (i, t, _), (_, u, _) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        n = len(t) // 2
        changed = t[: len(t) - n] + u[:n]
        a, b = print_(t), print_(changed)
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), fingerprints.near(a, b), fingerprints.near(a, print_(u))))
    for n in (1, 4, 13):
        got = [tuple(r) for r in fingerprints.with_next(frame(spark, rows), ranges=n).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert fingerprints.with_next(frame(spark, rows).limit(0)).count() == 0
    assert fingerprints.fingerprint(frame(spark, rows)).count() == len(rows)


def test_rows_without_an_id_or_of_one_are_spread(spark):
    rng = random.Random(31)
    rows = [(None, words(rng, 5), "s") for _ in range(200)] + [(7, words(rng, 5), "s") for _ in range(200)] + [(i, words(rng, 5), "s") for i in range(200)]
    cuts = fingerprints._cuts(frame(spark, rows).select("doc_id"), 16)
    held = Counter(fingerprints.bisect_right(cuts, fingerprints._place(i, hashlib.md5(t.encode()).digest())) for i, t, _ in rows)
    assert cuts == sorted(cuts) and max(held.values()) <= 100


# Toxicity


def brute_marginals(chain, e):
    n = len(e)
    total = hot = 0.0
    each = np.zeros(n)
    for states in range(1 << n):
        y = [states >> k & 1 for k in range(n)]
        p = 1.0
        before = None
        for k in range(n):
            p *= np.exp(e[k]) if y[k] else 1.0
            p *= chain.t[before, y[k]] if before is not None else chain.t[0, y[k]] + chain.first * chain.t[1, y[k]]
            before = y[k]
        total += p
        each += p * np.array(y)
        hot += p
    return each / total


def test_marginals_against_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 3)
    rng = np.random.default_rng(3)
    chain = toxicity.Chain(rng.normal(size=(2, 2)), -1.0)
    lengths = np.array([0, 1, 2, 7, 3, 0, 9])
    e = rng.normal(size=lengths.sum()) * 2
    got, at = chain.marginals(e, lengths), 0
    for n in lengths:
        assert np.allclose(got[at : at + n], brute_marginals(chain, e[at : at + n]))
        at += n
    assert chain.marginals(np.zeros(0), np.array([0, 0])).size == 0


def test_toxicity_of_a_table(spark):
    rng = random.Random(12)
    bad = ["idiot", "scumbag", "moron"]
    rows, labels = [], []
    for i in range(400):
        text, toxic = words(rng, rng.choice([20, 80]), 500).split(), i % 4 == 0
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), "s"))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (5, 1, None), (10**6, 0, 1)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "İ IDIOT é moron, you scumbag", "s"), (None, "fine words", "s"), (903, "quiet " * 20_000, "s"), (903, "quiet", "s")]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for i, _, y in labels[:400]:
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(by[i]["predicted"], y) for i, _, y in labels[:400] if by[i]["held_out"]]
    assert len(held) > 50 and sum(p == y for p, y in held) / len(held) > 0.97
    assert by[900]["predicted"] == by[901]["predicted"] == by[903]["predicted"] == 0 and by[902]["predicted"] == 1
    text = rows[0][1]
    assert {text[int(a) : int(b)] for a, b in (x.split(":") for x in by[0]["spans"].split(","))} <= set(bad)
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(r["predicted"] == 0 for r in out)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "x y", "s")])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs, model).first()["predicted"] == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_labels_of_held_out_rows_are_never_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.weights == b.weights and (a.calibration == b.calibration).all()


# The pipeline


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "pieces"]
    kept = {}
    for n, stage in cp.STAGES:
        before = docs
        docs = scratch.keep(stage(spark, docs, SMALL))
        kept[n] = docs
        if n != "pieces":
            assert docs.columns == columns
        if n == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
            bad = {r["doc_id"] for r in toxicity.score(before, model).where("predicted = 1").collect()}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - bad
        if n == "line_dedup":
            rows = [(r["doc_id"], r["text"], "") for r in before.collect()]
            assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted((i, t) for i, t, *_ in brute_lines(rows, linededup.LEAST_DOCS))
            assert docs.where("n_chars <> length(text)").count() == 0
        if n == "near_dedup":
            rows = [(r["doc_id"], r["text"], "") for r in before.collect()]
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(min(i for i, t, _ in rows if (t or "") in g) for g in brute_classes(rows))
        if n == "mixing":
            rows = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
            want = Counter()
            for (i, t, _), (_, _, size, *taken) in zip(rows, brute_mix(rows)[0], strict=True):
                want[i, t] += sum(size > 0 and 2 * w >= size for w in taken)
            assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == +want
        if n == "pieces":
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            want = sorted((r["doc_id"], len(library.encode(r["text"] or ""))) for r in before.collect())
            assert sorted((r["doc_id"], r["n_tokens"]) for r in docs.collect()) == want
    assert sorted(map(str, cp.run(spark, SMALL).collect())) == sorted(map(str, kept["pieces"].collect()))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op1_linededup", "op2_mixing"])
def test_queries_equal_their_sql(spark, name):
    from gridsmith.llm import registry

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    df = registry.QUERIES[name](spark, SMALL)
    rel = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr(list(r)) for r in rel.fetchall())
