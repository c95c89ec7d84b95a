"""The ten operators on small tables: brute force, round trips, odd inputs."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, images, langid, toxicity
from loomgraph.llm.components import components, extended
from loomgraph.llm.decontam import contaminated
from loomgraph.llm.lines import without_repeated_lines
from loomgraph.llm.minhash import near_duplicates
from loomgraph.llm.mixing import SCHEDULES, integral, mix, position
from loomgraph.llm.queries import tokenizer_path
from loomgraph.llm.shingles import shingle_sets, superminhash
from loomgraph.llm.spans import without_repeats
from loomgraph.llm.tokens import Encoder, Part, token_files, write_tokens

#: Null ids and texts, empty and blank ones, a repeated row, a name that clashes.
ODD = [(None, "a b c d e f", "s", 1), (1, None, None, 1), (2, "", "s", 1), (3, " \n\t ", "s", 1), (4, "x", "s", 1), (4, "x", "s", 1), (5, "y " * 5000, "s", 1)]
DOCS = "doc_id long, text string, source string, score int"
RNG = np.random.default_rng(7)
WORDS = ["".join(RNG.choice(list("abcdefghij"), 5)) for _ in range(400)]


def text(n):
    return " ".join(RNG.choice(WORDS, n))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# Shingles and groups


def test_sets_and_signatures():
    texts = [None, "", "One two", "a b c d e", "A  b\nc\td e", "a b c d e f"]
    sizes = [len(s) for s in shingle_sets(texts, 4)]
    assert sizes == [0, 0, 1, 2, 2, 3]
    a, b = shingle_sets(texts[3:5], 4)
    assert (a == b).all()
    errors = []
    for _ in range(60):
        x = RNG.integers(0, 1 << 60, 300).astype(np.uint64)
        sig = superminhash([np.sort(x[:270]), np.sort(x[30:])], 252)
        errors.append((sig[0] == sig[1]).mean() - 240 / 300)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.0252
    assert superminhash([], 8).shape == (0, 8)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 40), (60, 60), (None, 1)], "a long, b long")
    found = {r[0]: r[1] for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(21), 0), 40: 40, 50: 40}
    more = extended(components(links), spark.createDataFrame([(50, 20), (70, 71)], "a long, b long"))
    assert {r[0]: r[1] for r in more.collect()} == {**dict.fromkeys(range(21), 0), 40: 0, 50: 0, 70: 70, 71: 70}


def brute_groups(rows, width, percent):
    def shingles(t):
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    sets = {d: shingles(t) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_duplicates_like_brute_force(spark):
    rows, base = [], [text(120).split() for _ in range(4)]
    for k in range(120):
        words = list(base[k % 4])
        for at in RNG.choice(len(words), k % 9, replace=False):
            words[at] = "zz" + str(RNG.integers(1000))
        rows.append((k, " ".join(words).upper() if k % 7 == 0 else " ".join(words)))
    rows += [(200 + k, text(60)) for k in range(30)] + [(300, "same"), (301, "Same "), (302, ""), (303, None)]
    got = by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4))
    want = brute_groups(rows, 4, 80)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == d) for d, r in got.items())


def test_links_at_the_threshold_are_kept(spark):
    """Chains of copies whose ends a centre cannot link, at and just below 0.8."""
    rows, k = [], 0
    for group in range(12):
        base = text(90).split()
        for copy in range(14):
            words = list(base)
            for at in RNG.choice(range(0, 90, 6), 1 + copy % 5, replace=False):
                words[at] = f"v{group}x{copy}y{at}"
            if copy % 4 == 0 and rows:
                words = rows[-1][1].split()
                words[3 + 4 * (copy % 11)] = f"n{group}x{copy}"
            rows.append((k, " ".join(words)))
            k += 1
    rows += [(k + i, " ".join(f"u{j}" for j in range(20)) + tail) for i, tail in enumerate(("", " u20 u21 u22 u23", " u20 u21 u22 u23 u24"))]
    got = by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute_groups(rows, 4, 80)


def test_differences_from_a_centre_decide(spark):
    from loomgraph.llm import minhash

    base = text(80).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        words = list(base)
        for at in RNG.choice(80, 1 + k % 7, replace=False):
            words[at] = f"w{at % 3}{k % 5}"
        rows.append((k, " ".join(words)))
    sets = {d: set(shingle_sets([t], 4)[0].tolist()) for d, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 40)], "a long, b long")
    known = minhash.apart(pairs, docs, 4).withColumnRenamed("a", "doc_id")
    sizes = spark.createDataFrame([(d, len(s), d) for d, s in sets.items()], "doc_id long, n_shingles long, label long")
    most, minhash.MEMBERS = minhash.MEMBERS, 7
    got = {tuple(r) for r in minhash._between(known.join(sizes, "doc_id").withColumn("buckets", F.array(F.lit(1).cast("long"))), 80).collect()}
    minhash.MEMBERS = most
    assert got == {(a, b) for a, b in itertools.product(range(1, 40), repeat=2) if a > b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert got


def test_near_duplicates_odd(odd, none):
    rows = near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and sorted(r["n_shingles"] for r in rows) == [0, 0, 0, 1, 1, 1, 2]
    assert all(r["kept"] for r in rows)
    assert near_duplicates(none).collect() == []


# Toxicity


def test_grammar():
    model = toxicity.Model({"idiot": 4.0}, {})
    plain, aimed = model.clause(["an", "idiot"]), model.clause(["you", "idiot"])
    negated, reported = model.clause(["not", "an", "idiot"]), model.clause(["he", "said", "idiot"])
    assert reported < aimed and negated < plain < aimed and reported <= plain
    assert model.clause(["kill"]) < model.clause(["kill", "you"])
    assert model.clause(["a", "word"]) == 0
    assert model.clause(["idiot", "you"]) > plain and model.clause(["not", "a", "b", "c", "idiot"]) == plain
    kinds = [k for k, _ in model.matches(["she", "said", "you", "never", "idiot", "idiot"])]
    assert kinds == ['i@-"', 'i+@-"']


def test_composed_machine_is_its_parts_in_a_row():
    parts = (toxicity._insult, toxicity._threat, toxicity._target, toxicity._negation, toxicity._report)
    for _ in range(300):
        state, states = 0, [0] * len(parts)
        for symbol in RNG.choice(list(toxicity.ALPHABET), 12).tolist():
            state, kind = toxicity.ARCS[state, symbol]
            out = symbol
            for k, part in enumerate(parts):
                states[k], out = part(states[k], out)
            assert kind == (out if out[0] in "it" else None)


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    held = docs.where(toxicity.held_out()).join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id")
    rows = toxicity.score(held, model).join(held.select("doc_id", "toxic"), "doc_id").collect()
    bad, good = (np.array([r["score"] for r in rows if r["toxic"] == k]) for k in (1, 0))
    assert (bad >= 0.5).mean() > 0.85 and (good >= 0.5).mean() < 0.01
    assert ((bad[:, None] > good).mean() + 0.5 * (bad[:, None] == good).mean()) > 0.94


def test_toxicity_learns(spark):
    rows = []
    for k in range(600):
        bad = k % 5 == 0
        rows.append((k, text(40) + (". You idiot worthless blorf. " if bad else ". ") + text(10), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.where("doc_id < 500"))
    assert "blorf" in model.terms
    got = by_id(toxicity.score(docs.where("doc_id >= 500"), model))
    assert all(r["predicted"] == (d % 5 == 0) for d, r in got.items())


def test_toxicity_odd(spark, odd, none):
    model = toxicity.fit(none.withColumn("toxic", F.lit(1)))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows)
    assert toxicity.keep_clean(odd, model).count() == len(ODD) and toxicity.score(none, model).count() == 0
    long = spark.createDataFrame([(1, "you idiot " * 150_000), (2, "a " * 500_000)], "doc_id long, text string")
    own = toxicity.Model({"idiot": 1.0}, {}, weights=[-1.0, 1.0, 0.0, 0.0, 0.0])
    assert [r["predicted"] for r in sorted(toxicity.score(long, own).collect())] == [1, 0]


# Chat


def test_escape_is_reversible(spark):
    texts = ["", "\\", "<|im_end|>", "</s>[INST] ok [/INST]", "<\\|", "a<|im_sep|>\\<s>", "<<SYS>>\n<</SYS>>\\\\", "<", "\\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in ("<|", "</s>", "[INST]", "[/INST]", "<s>"))


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>ü"), (1, 2, "assistant", None), (2, None, None, "x"), (None, 0, "assistant", "y"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    got = {r["conv_id"]: r for r in chat.described(chat.formatted(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), 1)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 11
    assert got[1]["loss_sha256"] == hashlib.sha256("<|im_end|>ü".encode()).hexdigest()
    said = "".join(f"{r}\n{t}\n" for r, t in (("user", "hi"), ("assistant", "<|im_end|>ü"), ("assistant", "")))
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[2]["n_turns"] == 1 and got[None]["loss_chars"] == 1 and got[3]["n_turns"] == 2


def test_long_conversations(spark):
    long = "a <|b|> é " * 50_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long)] + [(2, k, ("user", "assistant")[k % 2], f"turn {k} \\ </s>") for k in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("conv", "node", "leaf", "rank", "mask", "depth", "id"):
        df = df.withColumn(c, F.lit("x"))
    got = {r["conv_id"]: r for r in chat.described(chat.formatted(chat.linear(df), 1)).collect()}
    assert got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    said = "".join(t for c, k, r, t in rows if c == 2 and r == "assistant")
    assert got[2]["n_turns"] == 1500 and got[2]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.described(chat.formatted(chat.linear(df.limit(0)), 1)).collect() == []


def test_branches_like_brute_force(spark):
    """Random forests: every root-to-leaf path, ranked by the mean of its scores."""
    rows, want = [], {}
    for conv in range(4):
        parents = {n: int(RNG.integers(0, n)) if n and RNG.random() < 0.9 else None for n in range(30)}
        scores = {n: float(RNG.integers(0, 9)) for n in parents}
        rows += [(conv, n, p, scores[n], "user", f"{n}") for n, p in parents.items()]
        paths = []
        for leaf in set(parents) - set(parents.values()):
            path = [leaf]
            while parents[path[0]] is not None:
                path.insert(0, parents[path[0]])
            paths.append((-sum(scores[n] for n in path) / len(path), leaf, path))
        want[conv] = [[str(n) for n in path] for _, _, path in sorted(paths)]
    df = spark.createDataFrame(rows, "conv long, node long, parent long, score double, role string, text string")
    got: dict = {}
    for r in chat.formatted(df).select("conv", "rank", chat.turns(F.col("formatted")).alias("turns")).collect():
        got.setdefault(r["conv"], {})[r["rank"]] = [t["text"] for t in r["turns"]]
    assert {c: [p[k] for k in sorted(p)] for c, p in got.items()} == want
    best = chat.formatted(df, 2).select("conv", "rank").collect()
    assert len(best) == 8


def test_reply_tree(spark):
    rows = [(1, None, 0.0, "r"), (2, 1, 1.0, "a"), (3, 1, 5.0, "b"), (4, 2, 9.0, "c"), (5, 3, 0.0, "d"), (6, 99, 7.0, "orphan"), (7, 8, 1.0, "loop"), (8, 7, 1.0, "loop")]
    df = spark.createDataFrame([(1, n, p, s, "user", t) for n, p, s, t in rows], "conv long, node long, parent long, score double, role string, text string")
    got = {r["rank"]: [t["text"] for t in r["turns"]] for r in chat.formatted(df).select("rank", chat.turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: ["orphan"], 2: ["r", "a", "c"], 3: ["r", "b", "d"]}
    assert chat.formatted(df, 1).count() == 1 and chat.formatted(df.limit(0)).count() == 0


# Mixing


def test_mix(spark):
    rows = [(k, text(int(RNG.integers(1, 60))), ["a", "b", "c", None][k % 4]) for k in range(200)] + [(900, "w " * 5, "tiny")]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = sum(r["size"] for r in got)
    sources = {}
    for r in got:
        s = sources.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"]
        s[1] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and len(r["positions"]) >= (r["taken"] > 0) and all(0 <= t <= 1 for t in r["positions"])
    assert abs(sum(s[2] for s in sources.values()) - total) < 1e-6
    for size, taken, target, source_size in sources.values():
        assert source_size == size and taken == int(target) and target <= 3 * size
    assert sources["tiny"][2] == 15  # at its limit
    starts = [r["positions"][0] for r in got if r["positions"]]
    assert starts == sorted(starts)


def test_schedules_are_inverted(spark):
    for knots in SCHEDULES:
        got = [r[0] for r in spark.range(11).select(position(F.col("id") / 10, knots)).collect()]
        for share, t in zip(np.arange(11) / 10, got, strict=True):
            grid = np.linspace(0, t, 2001)
            own = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots])
            assert abs(np.trapezoid(own, grid) / integral(knots)[-1] - share) < 1e-4


def test_targets_follow_the_integrals(spark):
    rows = [(k, "w " * 10, "abc"[k % 3]) for k in range(300)]
    flat = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (1.0, 4.0)), ((0.0, 0.0), (0.5, 4.0), (1.0, 0.0)))
    got = {r["source"]: r["target"] for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), (1, 1, 2), 3, flat).collect()}
    assert got == {"a": 3000 / 8, "b": 3000 * 3 / 8, "c": 3000 * 4 / 8}


def test_mix_odd(odd, none):
    rows = mix(odd).collect()
    blank = mix(odd.withColumn("text", F.when(F.col("doc_id") > 2, F.col("text"))).withColumn("source", F.col("doc_id").cast("string"))).collect()
    assert len(blank) == len(ODD) and all(r["taken"] == 0 and r["positions"] == [] for r in blank if r["doc_id"] in (1, 2))
    assert len(rows) == len(ODD) and "score" in rows[0].asDict() and sum(r["taken"] for r in rows if r["doc_id"] == 1) == 0
    assert mix(none).collect() == []


# Spans and lines


def test_spans(spark):
    passage = "This is a sentence of the passage that repeats. Here comes another one with many words in it. And a third one ends it here."
    rows = [(1, f"Start one here now. {passage} Own end of the first."), (2, f"Glued before {passage} Then other words follow here."), (3, "All of this is clean. Nothing repeats in it at all today.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(without_repeats(docs, least_words=10))
    assert got[1]["n_removed"] == 0 and got[1]["text"] == rows[0][1] and got[3]["text"] == rows[2][1]
    assert got[2]["n_removed"] == 2 and got[2]["text"] == "Glued before This is a sentence of the passage that repeats. Then other words follow here."
    # By default, so few words that repeat are no passage.
    assert by_id(without_repeats(docs))[2]["text"] == rows[1][1]


def brute_spans(rows, span, least):
    """What is left of each text by comparing words as they are, span by span."""
    from loomgraph.llm.spans import cuts, sentences

    seen, kept = {}, {}
    long = 24
    for (d, t) in sorted(rows):
        (start, hashes, first), = sentences([t])
        w = [x.lower() for x in t.split()]
        edges = [*first.tolist(), len(w)]
        found = set()
        for m in range(len(edges)):
            stop = next((k for k in range(m + span, len(edges)) if edges[k] - edges[m] >= least), None)
            begin = next((k for k in range(m - span, -1, -1) if edges[m] - edges[k] >= least), None)
            found |= {(edges[m], edges[stop])} if stop is not None else set()
            found |= {(edges[begin], edges[m])} if begin is not None else set()
        cut = cuts(hashes).tolist()
        for c in cut:
            end = next((e for e in cut if e - c >= long), None)
            found |= {(c, end)} if end is not None else set()
        lost = set()
        for a, b in sorted(found):
            e, at = seen.setdefault(tuple(w[a:b]), (d, a))
            if (e, at) != (d, a):
                lost |= set(range(a if e != d else max(a, at + b - a), b))
        kept[d] = [x for k, x in enumerate(t.split()) if k not in lost]
    return kept


def test_spans_like_brute_force(spark):
    passages = [". ".join(text(int(n)) for n in RNG.integers(2, 30, 5)) + "." for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [text(int(RNG.integers(0, 20))), passages[k % 6] if k % 3 else text(40), text(5) + ".", passages[RNG.integers(6)][: int(RNG.integers(50, 400))], text(12)]
        rows.append((k, " ".join(parts).strip()))
    got = by_id(without_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute_spans(rows, 2, 24)
    assert {d: r["text"].split() for d, r in got.items()} == want
    assert any(len(want[d]) < len(t.split()) for d, t in rows)


def test_spans_of_texts_that_share_an_id(spark):
    a, b, c = text(60), text(60), text(30)
    got = without_repeats(spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (3, c)], "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in got if r["doc_id"] != 2) == sorted([a, c])
    left = sorted((r["text"] for r in got if r["doc_id"] == 2), key=len)
    assert len(left[0].split()) < 40 and left[1:] == [b, b]


def test_spans_odd(odd, none):
    rows = without_repeats(odd).collect()
    assert len(rows) == len(ODD) and {r["text"] for r in rows if r["doc_id"] == 1} == {None}
    assert without_repeats(none).collect() == []


def test_spans_of_short_sentences(spark):
    passage = " ".join(f"{w}.!!" for w in text(40).split())
    tail = "A sentence that holds as many as ten words is here. Now one with a few more words than that is here. So. It ends."
    rows = [(1, f"One begins. {passage}"), (2, f"Two begins here. {passage} Two ends."), (3, tail), (4, f"Glued. {tail}"), (5, "same. " * 100)]
    got = by_id(without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), least_words=10))
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == tail
    assert got[2]["text"] == "Two begins here. Two ends." and got[2]["n_removed"] == 40
    assert got[4]["text"] == "Glued. " and got[4]["n_removed"] == 4
    assert got[5]["text"] == "same. " * 10 and got[5]["n_removed"] == 90


def test_spans_inside_sentences(spark):
    from loomgraph.llm.spans import LONG

    passages = [text(50) for _ in range(60)] + [". ".join(text(18) for _ in range(3)) for _ in range(20)]
    rows = [(k, f"{text(30)} {p} {text(25)}") for k, p in enumerate(passages)] + [(100 + k, f"{text(7)} {p} {text(40)}, {text(3)}") for k, p in enumerate(passages)]
    got = by_id(without_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    for d, t in rows:
        kept, n = got[d]["text"].split(), len(t.split())
        if d < 100:
            assert got[d]["text"] == t
        else:
            assert n - 54 <= len(kept) <= n - LONG and kept[:7] == t.split()[:7] and kept[-43:] == t.split()[-43:]


def test_lines_like_brute_force(spark):
    from functools import cache

    @cache
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        a, b = sorted((a, b), key=len)
        i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])

    pool = ["".join(RNG.choice(list("ab é"), int(RNG.integers(10, 17)))).strip() for _ in range(25)]
    pool += [p[:k] + c + p[k + e :] for p in pool[:15] for k, c, e in ((0, "", 1), (5, "x", 0), (8, "y", 1), (len(p) - 1, "", 1))]
    pool += ["", "short", "shor", "hort", "one", "ones", "q", "tw", "twx", "Yes!", "Yes", "12345"]
    rows = [(d, "\n".join(pool[i] for i in RNG.integers(0, len(pool), 12))) for d in range(30)]
    got = by_id(without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    seen: list[str] = []
    for d, t in rows:
        kept = []
        for line in t.split("\n"):
            own = line.strip(" ")
            if own and any(near(x, own) for x in seen):
                seen.append(own)
                continue
            if own:
                seen.append(own)
            kept.append(line)
        assert got[d]["text"] == "\n".join(kept)
        assert got[d]["n_lines"] == sum(x.strip(" ") != "" for x in t.split("\n"))


def test_lines_of_one_edit_at_every_place(spark):
    base = "".join(RNG.choice(list("abcdefgh"), 37))
    edits = [base[:k] + c + base[k + e :] for k in range(38) for c, e in (("", 1), ("X", 0), ("Y", 1)) if k < 37 or c == "X"]
    far = [base[:k] + "XX" + base[k + 2 :] for k in range(35)]
    rows = [(0, base), *[(k, t) for k, t in enumerate(edits, 1)]]
    got = by_id(without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[k]["n_removed"] for k in range(len(rows))] == [0] + [1] * len(edits)
    got = by_id(without_repeated_lines(spark.createDataFrame([(0, base), (1, far[4]), (2, far[20])], "doc_id long, text string")))
    assert all(r["n_removed"] == 0 for r in got.values())


def test_lines_of_200_000_characters(spark):
    line = "".join(RNG.choice(list("abcdefgh é"), 199_998))
    rows = [(1, f"q{line}x"), (2, f"q{line}y"), (3, f"q{line[:777]}z{line[777:]}x"), (4, f"q{line[::-1]}x"), (5, f"qq{line}xy")]
    got = by_id(without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[k]["n_removed"] for k in range(1, 6)] == [0, 1, 1, 0, 0] and got[2]["text"] == "" and got[5]["text"] == rows[4][1]


def test_lines_of_texts_that_share_an_id(spark):
    a, b, c = "the first line of all\nand another one", "nothing of this is like\nanything else here", "left alone"
    got = without_repeated_lines(spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (3, c)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in got) == [(1, a, 0), (2, "", 2), (2, b, 0), (2, b, 0), (3, c, 0)]


def test_lines_odd(odd, none):
    rows = without_repeated_lines(odd).collect()
    assert len(rows) == len(ODD) and sum(r["n_removed"] for r in rows) == 0
    assert without_repeated_lines(odd.withColumn("row", F.lit("x")).withColumn("at", F.lit(1))).count() == len(ODD)
    assert without_repeated_lines(none).collect() == []


# Token files


def library(text, special_as_text=False):
    """The library's own tokenizer, untouched but for that switch."""
    from tokenizers import Tokenizer

    if special_as_text not in _LIBRARY:
        _LIBRARY[special_as_text] = Tokenizer.from_file(tokenizer_path())
        if special_as_text:
            _LIBRARY[special_as_text].encode_special_tokens = True
    return _LIBRARY[special_as_text].encode(text, add_special_tokens=False).ids


_LIBRARY: dict = {}


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_is_exact(special_as_text):
    enc = Encoder(tokenizer_path(), special_as_text)
    parts = [*"ab A.,'s1 \n\t é字  \r%", "<|endoftext|>", "don't", "\n\n", " \n", "word", "...", "-->", "\u0085", "ß²", "<|endoftext"]
    for _ in range(4000):
        t = "".join(RNG.choice(parts, int(RNG.integers(0, 14))))
        assert np.frombuffer(enc.encode(t), np.uint16).tolist() == library(t, special_as_text), t
    assert library("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_encoder_forgets(monkeypatch):
    from loomgraph.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 30)
    enc = Encoder(tokenizer_path())
    for _ in range(300):
        t = text(20)
        assert np.frombuffer(enc.encode(t), np.uint16).tolist() == library(t)
        assert len(enc.ids) <= 30 and len(enc.ids.old) <= 30


@pytest.mark.parametrize("special_as_text", [False, True])
def test_texts_encoded_together(special_as_text):
    enc = Encoder(tokenizer_path(), special_as_text)
    parts = [*"abcé字中 A.,'s1²  \n\n", "<|endoftext|>", "don't", " \t", "\u0085", "\u00a0", "\0", "ä-b", "...", " word,", "\nWord;", "à à"]
    texts = ["", " ", "\n", "a", ".", *("".join(RNG.choice(parts, int(RNG.integers(0, 14)))) for _ in range(4000))]
    for some in (texts, [], [""], ["\t"]):
        assert [np.frombuffer(r, np.uint16).tolist() for r in enc.encode_all(some)] == [library(t, special_as_text) for t in some]


def test_the_library_gets_each_word_once():
    class Counting:
        def __init__(self, library):
            self.library, self.size = library, 0

        def encode(self, text, **how):
            self.size += len(text)
            return self.library.encode(text, **how)

        def encode_batch_fast(self, texts, **how):
            self.size += sum(map(len, texts))
            return self.library.encode_batch_fast(texts, **how)

    enc = Encoder(tokenizer_path())
    enc.tokenizer, enc.bare = Counting(enc.tokenizer), Counting(enc.bare)
    words = ["".join(RNG.choice(list("aeiouxyz"), 9)) for _ in range(500)]
    texts = [" ".join(w + str(RNG.choice(["", ",", ".", "!!"])) for w in RNG.permutation(words)) for _ in range(20)]
    got = enc.encode_all(texts)
    assert [np.frombuffer(r, np.uint16).tolist() for r in got] == [library(t) for t in texts]
    assert enc.tokenizer.size + enc.bare.size < 1.1 * sum(len(w) + 1 for w in words)


def test_token_files(spark, odd, none, tmp_path):
    rows = [(k * 3 % 50, text(int(RNG.integers(0, 40))) + (" <|endoftext|> x" if k % 9 == 0 else "")) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def check(got, wanted):
        at = 0
        for r, (d, t) in zip(sorted(got, key=lambda r: r["start"]), wanted, strict=True):
            ids = np.append(library(t), 0)
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
            at += len(ids)
        return at

    at = check(token_files(docs, str(tmp_path / "t"), tokenizer_path(), 0, 3).collect(), sorted(rows))
    parts = write_tokens(docs, str(tmp_path / "u"), tokenizer_path(), 0, 3)
    read = [Part(str(tmp_path / "u"), p["name"]) for p in parts]
    assert sum(len(p.tokens(0, p.total)) for p in read) == at and [p["base"] for p in parts] == list(np.cumsum([0, *[p["n_tokens"] for p in parts]])[:-1])
    assert isinstance(read[0].data, np.memmap) and len(list((tmp_path / "u").iterdir())) == 2 * len(parts) + 1
    by_text = docs.withColumn("at", F.md5("text"))
    check(token_files(by_text, str(tmp_path / "v"), tokenizer_path(), 0, 3, ("at", "doc_id")).collect(), sorted(rows, key=lambda r: (hashlib.md5(r[1].encode()).hexdigest(), r[0])))
    rows = sorted(token_files(odd, str(tmp_path / "o"), tokenizer_path()).collect(), key=lambda r: r["start"])
    assert len(rows) == len(ODD) and rows[0]["doc_id"] is None and [r["n_tokens"] for r in rows[1:3]] == [1, 1]
    rows = sorted(token_files(odd, str(tmp_path / "w"), tokenizer_path(), order=("text",)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [1, 2, 3, None, 4, 4, 5]
    assert token_files(none, str(tmp_path / "n"), tokenizer_path()).collect() == []


def test_token_files_of_a_long_text(spark, tmp_path):
    long = "word and another. " * 60_000
    got = token_files(spark.createDataFrame([(1, long), (2, "x")], "doc_id long, text string"), str(tmp_path / "l"), tokenizer_path(), 0, 1).collect()
    assert sorted(r["n_tokens"] for r in got) == [2, len(library(long)) + 1]


# Decontamination


def test_templates(spark, odd, none):
    item = "Every morning Anna Bell walks 12 km to the old market and buys 3.5 kg of red apples for her friend Tom, who pays 12 euros to Anna Bell each week."
    same = item.replace("Anna Bell", "Peter Hall").replace("12", "20").replace("3.5", "9").replace("Tom", "Sue")
    mixed = same.replace("to Peter Hall each", "to Mary Ann each").replace("pays 20", "pays 21")
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "too short", 0), (None, item, 0)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(1, f"Before. {item} After."), (2, f"Before. {same} After."), (3, f"Before. {mixed} After."), (4, text(100)), (5, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1]["changed"] == 0 and got[2, 1]["changed"] == 4
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench, most_broadcast=0).collect()} == set(got)
    assert contaminated(odd, bench).collect() == [] and contaminated(none, bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []


def test_templates_of_repeated_items(spark):
    item, other = text(40), text(30)
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, f"before {other} after"), (3, text(100))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (2, other)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["windows"]) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 1): (36, 36), (1, 2): (36, 36), (2, 2): (26, 26)}


def test_templates_of_another_case(spark):
    item = "While Tom was in the old town, he and Sue bought ten red apples, two green pears, a loaf of bread, some salt, and a map of the river, all for 12 euros."
    docs = spark.createDataFrame([(1, f"BEFORE. {item.upper()} AFTER."), (2, item.title()), (3, item), (4, item.replace("apples", "onions").replace("green", "ripe").upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in contaminated(docs, bench).collect()}
    assert set(got) == {1, 2, 3} and got[1]["matched"] == got[1]["windows"] and got[3]["slots"] > 0


def test_only_texts_with_literal_windows_are_canonicalised(spark, monkeypatch):
    from loomgraph.llm import decontam

    seen, stored = {}, decontam.stored

    def storing(df, name):
        seen[name] = stored(df, name)
        return seen[name]

    monkeypatch.setattr(decontam, "stored", storing)
    item, other = f"{text(30)} 12 kg {text(6)}", "we had 12 big 13 red 14 old 15 new 16 cups"
    docs = [(1, f"x {item.replace('12', '15')} y"), (2, other.replace("12", "92")), (3, text(80)), (4, f"{text(20)} = <{item}>"), (5, " \n")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    both = contaminated(docs, bench).collect()
    one = contaminated(docs, bench.where("item_id = 1")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["changed"]) for r in both) == [(1, 1, 1), (2, 2, 1), (4, 1, 0)]
    assert sorted(one) == sorted(r for r in both if r["item_id"] == 1)
    # The words of each text are looked up once, and no template of the third one.
    assert {r["row"] for r in seen["words"].where("not plain").collect()} == {r["row"] for r in seen["held"].collect()} and seen["words"].count() > 0


def test_items_without_windows(spark):
    bench = spark.createDataFrame([(1, "What is 2 + 2?"), (2, "7 8 9 10 11 12"), (3, "..."), (4, "Yes")], "item_id long, text string")
    rows = [(1, "what is 31 + 31"), (2, "What is 2 + 3?"), (3, "He asked what is 2 + 2 and left."), (4, "1 2 3 4 5 6"), (5, "1 2 3 4 5 6 7"), (6, "yes!"), (7, "Yes, yes"), (8, "?!"), (9, "What is 2 + 2?")]
    got = {(r["doc_id"], r["item_id"]): (r["slots"], r["changed"]) for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    # Two values of one slot value, as in (2, 1), are another question.
    assert got == {(1, 1): (1, 1), (4, 2): (6, 6), (6, 4): (0, 0), (9, 1): (1, 0)}


def test_templates_of_long_runs(spark):
    names = " ".join(f"Nn{chr(97 + k % 26)}" for k in range(400))
    item = f"We heard that on that day the long list of guests named {names} was read aloud by the old man at the door of the hall, all 12 pages of it."
    other = item.replace("Nna", "Zza").replace("12", "15")
    docs = spark.createDataFrame([(1, f"{text(30)}. {item} {text(20)}"), (2, other), (3, "A B " * 50_000 + item)], "doc_id long, text string")
    got = {r["doc_id"]: (r["slots"], r["changed"]) for r in contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (2, 0), 2: (2, 2), 3: (2, 0)}


def test_texts_that_share_an_id_are_not_added_up(spark):
    item = text(40)
    half = item.split()
    docs = spark.createDataFrame([(1, " ".join(half[:22])), (1, " ".join(half[18:])), (2, item), (2, text(30)), (None, item)], "doc_id long, text string")
    got = [(r["doc_id"], r["matched"]) for r in contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()]
    assert got == [(2, 36)]


def test_templates_like_brute_force(spark):
    items = [f"{text(6)} {k} kg {text(8)} {k + 1} {text(9)}" for k in range(10, 22)]
    rows = []
    for k in range(80):
        w = items[k % 12].split()
        for at in RNG.choice(len(w), k % 6, replace=False):
            w[at] = "qq" if w[at].isalpha() else str(RNG.integers(100))
        rows.append((k, f"{text(5)} {' '.join(w)} {text(4)}"))

    def tokens_of(t):
        return [("<num>" if x.isdigit() else "<unit>" if x == "kg" else x, x) for x in t.split()]

    def holds(doc, item):
        d, i = tokens_of(doc), tokens_of(item)
        grams = {}
        for a in range(len(d) - 4):
            grams.setdefault(tuple(x for x, _ in d[a : a + 5]), []).append(a)
        at = [a for a in range(len(i) - 4) if sum(x[0] != "<" for x, _ in i[a : a + 5]) >= 3]
        plain_d = {tuple(x for _, x in d[a : a + 5]) for a in range(len(d) - 4)}
        plain_i = [a for a in range(len(i) - 4) if sum(not x.isdigit() for _, x in i[a : a + 5]) >= 3]
        if sum(tuple(x for _, x in i[a : a + 5]) in plain_d for a in plain_i) >= 0.8 * len(plain_i):
            return True
        hit = [a for a in at if tuple(x for x, _ in i[a : a + 5]) in grams]
        if len(hit) < 0.8 * len(at):
            return False
        shifts = {}
        for a in range(len(i) - 4):
            for b in grams.get(tuple(x for x, _ in i[a : a + 5]), []):
                shifts.setdefault(b - a, []).append(a)
        best = max(shifts, key=lambda s: (len(shifts[s]), s))
        values = {}
        for a in shifts[best]:
            for j in range(a, a + 5):
                if i[j][0][0] == "<":
                    values.setdefault(i[j][1], set()).add(d[j + best][1])
        return sum(len(v) == 1 for v in values.values()) >= 0.9 * len(values)

    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    want = {(d, k) for d, t in rows for k, item in enumerate(items) if holds(t, item)}
    assert got == want and 10 < len(want) < 60


# Languages


def test_languages(spark, odd, none):
    kinds = {"x": "abcde", "y": "aefgh"}
    rows = [(k, " ".join("".join(RNG.choice(list(kinds[lang]), 6)) for _ in range(30)), lang) for k in range(200) for lang in [("x", "y")[k % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scorer = langid.fit(docs.where("doc_id < 150"))
    got = by_id(langid.identify(docs.where("doc_id >= 150"), scorer))
    assert all(r["lang_pred"] == ("x", "y")[d % 2] and 0.5 < r["score"] <= 1 for d, r in got.items())
    signs = spark.createDataFrame([(1, "² ½ ① 12"), (2, "_ 3"), (3, "ª"), (4, "a" * 3_000_000)], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in sorted(langid.identify(signs, scorer).collect())] == [True, True, False, False]
    out = langid.identify(odd, scorer).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in out}[1] == "und" and len(out) == len(ODD)
    nothing = langid.fit(none.withColumn("lang", F.lit("x")))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_code_lengths_are_exact():
    texts = ["abracadabra abra", "banana bandana"]
    codes, n = np.unique(langid._grams(texts)[0], return_counts=True)
    tree = langid.Tree(codes, n)
    scorer = langid.Scorer({"x": tree}, np.unique(langid._grams(texts)[0] & 0xFFFF))
    counts: dict = {}
    for t in texts:
        raw = b"\n\n\n" + t.encode()
        for i in range(3, len(raw)):
            for k in range(4):
                own = counts.setdefault(raw[i - k : i], {})
                own[raw[i]] = own.get(raw[i], 0) + 1

    def bits(t):
        raw, total = b"\n\n\n" + t.encode(), 0.0
        for i in range(3, len(raw)):
            for k in (3, 2, 1, 0):
                own = counts.get(raw[i - k : i])
                if own is None:
                    continue
                s = sum(own.values()) + len(own)
                if raw[i] in own:
                    total -= np.log2(own[raw[i]] / s)
                    break
                total -= np.log2(len(own) / s)
            else:
                total += 8
        return total

    for t in ["abra", "banana abracadabra", "quite other", "ab\nxé"]:
        assert abs(scorer.bits([t])[0, 0] - bits(t)) < 1e-9


# Images


def drawn(spark, n=30, size=64):
    return spark.createDataFrame([(k, [float(x) for x in RNG.normal(size=size)]) for k in range(n)], "vec_id long, embedding array<double>")


def test_images(spark):
    vectors = drawn(spark).union(spark.createDataFrame([(40, None), (None, [1.0, 2.0]), (41, [])], "vec_id long, embedding array<double>"))
    shown = images.pictures(vectors.union(vectors.where("vec_id = 3").withColumn("vec_id", F.lit(31).cast("long"))))
    found = {}
    for k, edit in enumerate(images.EDITS):
        one = images.pictures(vectors.where("vec_id < 10"), edit).select((F.col("image_id") + 1000 * k).alias("query_id"), "image")
        asked = one if not k else asked.union(one)
    asked = asked.withColumn("copies", F.lit("x")).withColumn("key", F.lit(1))
    for r in images.edited_copies(asked, shown.withColumn("votes", F.lit(0))).collect():
        found.setdefault(r["query_id"], {})[r["class_id"]] = r["copies"]
    right = [sum(k in found.get(k + 1000 * e, {}) for k in range(10)) for e in range(len(images.EDITS))]
    assert right[0] == right[1] == 10 and min(right) >= 8 and sum(right) >= 47
    assert all(set(c) == {q % 1000} for q, c in found.items()) and found[3][3] == 2
    assert images.edited_copies(asked.limit(0), shown).collect() == [] and images.edited_copies(asked, shown.limit(0)).collect() == []
    junk = spark.createDataFrame([(1, b"junk"), (2, None), (None, b"P5 1 1 255\n0"), (3, bytes(images.encode_pgm(np.zeros((30, 30)))))], "image_id long, image binary")
    assert images.edited_copies(junk.withColumnRenamed("image_id", "query_id"), junk).collect() == []
    assert {r[0] for r in images.unreadable(junk).collect()} == {1, 2}


def test_hamming_tables_find_all(spark):
    from loomgraph.llm.common import stored

    vectors = drawn(spark, 12)
    a = stored(images.descriptors(images.pictures(vectors, "crop").withColumnRenamed("image_id", "key")), "a")
    b = stored(images.descriptors(images.pictures(vectors).withColumnRenamed("image_id", "key")), "b")
    got = {(r["q_key"], r["q_no"], r["i_key"], r["i_no"]) for r in images._meeting(a, b).collect()}
    left, right = ([(r["key"], r["no"], np.array([r[w] for w in images.WORDS], np.int32)) for r in d.collect()] for d in (a, b))
    want = {(k, i, m, j) for k, i, x in left for m, j, y in right if np.bitwise_count((x ^ y).view(np.uint32)).sum() <= images.MOST_BITS}
    assert got == want and len(want) > 50


def test_corners_follow_the_size(spark):
    """A small part of a large picture is found: corners are kept by tile."""
    field = images.resized(RNG.normal(128, 60, (40, 40)), 10)
    whole, part = (images.encode_pgm(x) for x in (field, field[250:330, 30:120]))
    other = images.encode_pgm(images.resized(RNG.normal(128, 60, (40, 40)), 10))
    shown = spark.createDataFrame([(1, whole), (2, other)], "image_id long, image binary")
    got = images.edited_copies(spark.createDataFrame([(7, part)], "query_id long, image binary"), shown).collect()
    assert [(r["query_id"], r["class_id"]) for r in got] == [(7, 1)]


def test_votes_of_near_copies(spark, monkeypatch):
    """Votes make a row for two images, and none for each cell of each match; pairs with
    many matches, and pairs that end in another batch, get the same result."""
    own = np.random.default_rng(11)
    one = own.normal(size=64)
    vectors = spark.createDataFrame([(k, [float(x) for x in one + own.normal(scale=0.03, size=64)]) for k in range(40)], "vec_id long, embedding array<double>")
    asked, shown = images.pictures(vectors.where("vec_id % 10 = 0"), "crop").withColumnRenamed("image_id", "query_id"), images.pictures(vectors)
    plans, real = {}, images.stored
    monkeypatch.setattr(images, "stored", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or real(df, name))
    found = {tuple(r) for r in images.edited_copies(asked, shown).collect()}
    assert "Generate" not in plans["best"] and len(found) == 4 * 40
    monkeypatch.setattr(images, "MOST_MATCHES", 20)  # some pairs have more, some have not
    assert {tuple(r) for r in images.edited_copies(asked, shown.union(shown.where("image_id = 3"))).collect()} == found and "Generate" in plans["best"]
    monkeypatch.setattr(images, "MOST_MATCHES", 10_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {tuple(r) for r in images.edited_copies(asked, shown).collect()} == found
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_queries_are_compared_once(spark, monkeypatch):
    own = np.random.default_rng(12)
    vectors = spark.createDataFrame([(k, [float(x) for x in own.normal(size=64)]) for k in range(3)], "vec_id long, embedding array<double>")
    one, shown = images.pictures(vectors, "crop"), images.pictures(vectors)
    # Query 100 * n + k shows image k.
    asked = one.crossJoin(spark.range(50).withColumnRenamed("id", "n")).select((F.col("image_id") + 100 * F.col("n")).alias("query_id"), "image")
    made, real = {}, images.stored
    monkeypatch.setattr(images, "stored", lambda df, name: made.setdefault(name, real(df, name)))
    got = sorted((r["query_id"], r["class_id"]) for r in images.edited_copies(asked, shown).collect())
    assert got == sorted((100 * n + k, k) for n in range(50) for k in range(3))
    assert {r[0] for r in made["pairs"].select("q_key").distinct().collect()} == {0, 1, 2}


def png(image, colour=0, depth=8, palette=None, interlaced=False):
    import struct

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = image.shape[:2]
    passes = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)) if interlaced else ((0, 0, 1, 1),)
    rows = b""
    for y, x, dy, dx in passes:
        part = image[y::dy, x::dx]
        step = max(1, depth // 8 * (image.shape[2] if image.ndim == 3 else 1))
        above = None
        for k, r in enumerate(part if part.size else []):
            raw = np.frombuffer(r.astype(">u2").tobytes() if depth == 16 else np.packbits(np.unpackbits(r[:, None], axis=1)[:, -depth:].ravel()).tobytes() if depth < 8 else r.tobytes(), np.uint8).astype(int)
            above = np.zeros(len(raw), int) if above is None else above
            left, corner = (np.concatenate((np.zeros(step, int), v[:-step])) if len(v) > step else np.zeros(len(v), int) for v in (raw, above))
            guess = left + above - corner
            da, db, dc = (abs(guess - v) for v in (left, above, corner))
            paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
            kind = k % 5
            rows += bytes([kind]) + ((raw - (0, left, above, (left + above) // 2, paeth)[kind]) & 255).astype(np.uint8).tobytes()
            above = raw
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png():
    grey = RNG.integers(0, 256, (19, 13), np.uint8)
    rgb = RNG.integers(0, 256, (11, 9, 3), np.uint8)
    deep = RNG.integers(0, 65536, (7, 6)).astype(np.uint16)
    few = RNG.integers(0, 4, (9, 10), np.uint8)
    palette = RNG.integers(0, 256, (4, 3), np.uint8)
    assert (images.decode(png(grey)) == grey).all() and (images.decode(png(grey, interlaced=True)) == grey).all()
    assert np.allclose(images.decode(png(rgb, 2)), rgb.mean(2)) and np.allclose(images.decode(png(deep, depth=16)), deep / 257)
    assert np.allclose(images.decode(png(few, depth=2)), few * 85.0)
    assert np.allclose(images.decode(png(few, 3, 2, palette)), palette[few].mean(2)) and np.allclose(images.decode(png(few, 3, 8, palette, True)), palette[few].mean(2))
    assert (images.decode(images.encode_pgm(grey)) == grey).all()
    assert images.decode(b"junk") is None and images.decode(None) is None and images.decode(png(grey)[:60]) is None
