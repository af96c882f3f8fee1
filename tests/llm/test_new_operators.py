"""N-gram join, filter audit and prefix trie against brute force and SQL, on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from touchline.llm import conversation_trie, filter_audit, ngram_join, secret_scan
from touchline.llm import queries as corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def records(df):
    return sorted(tuple(r) for r in df.collect())


def duck(**frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    return con


def sorted_rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False))


# ---- n-gram join


def shingle_set(text, width=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(table):
    sets = {d: shingle_set(t) for d, t in table if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return sorted([(d, len(s), root(d)) for d, s in sets.items()])


def texts():
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    out = [None, "", " \t\n", "one", "ONE", "one two", "One  Two", "one two three", "straße ß", "STRASSE"]
    for n in (8, 12, 19, 22, 40, 150, 600, 2500):
        base = prose(n)
        out.append(" ".join(base))
        for k in range(14):  # copies with more and more words changed, on both sides of the threshold
            copy = list(base)
            for _ in range(max(1, k * n // 400)):
                copy[rng.randrange(n)] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(copy if k % 3 else copy[: -max(1, k * n // 300)]))
    out += ["loop " * 500, "loop " * 700, "A b C d E f", "a B c D e F"]
    rng.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


def test_ngram_join_against_brute_force(spark):
    table = texts()
    docs = spark.createDataFrame([(d, t, 1, "clash", 2) for d, t in table], "doc_id long, text string, n_shingles int, key string, rep int").repartition(4)
    want = brute_components(table)
    assert records(ngram_join.similar_components(docs)) == want
    assert len({c for _, n, c in want if n}) < len([1 for _, n, c in want if n]) - 20


def test_ngram_join_at_a_low_threshold(spark):
    """Sets of up to twice the size link, over several bands."""
    table = texts()[::3]
    sets = {d: shingle_set(t) for d, t in table}
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(spark.createDataFrame(table, "doc_id long, text string"), similar=(1, 2)).collect()}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 2 * both >= len(sets[a] | sets[b]):
            assert got[a] == got[b]


def test_ngram_join_in_blocks(spark, monkeypatch):
    """Without hub rounds every pair goes through the blocks, most of them by ``_within``."""
    table = texts()
    docs = spark.createDataFrame(table, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    monkeypatch.setattr(ngram_join, "LISTED", 1)
    monkeypatch.setattr("touchline.llm.minhash.BLOCK", 3)
    assert records(ngram_join.similar_components(docs)) == brute_components(table)


def test_ngram_join_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d"), (None, None), (4, "a b c d"), (4, "a b c d"), (2, "A b c d"), (9, None)]
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 2, 0), (2, 2, 2), (4, 2, 2), (4, 2, 2), (9, 0, 9)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_components(empty).count() == 0


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(10, 900))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[int(rng.integers(0, n // 4 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)])
        words = np.array([max(2, n // 9)] * 2)
        value, _, at = ngram_join.sketch(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), words)
        apart = int(np.bitwise_count(value[: at[1]] ^ value[at[1] :]).sum())
        assert apart <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("similar", [(90, 100), (75, 100), (1, 2)])
def test_bands_hold_every_similar_size(similar):
    ends = ngram_join.edges(10**6)
    words = ngram_join.sketch_words(similar, ends)
    band = lambda n: int(np.searchsorted(ends, n, "right")) - 1
    for b in [*range(1, 400), 5000, 77_777]:
        for a in range(ngram_join.lower_size(b, similar), b + 1, max(1, b // 50)):
            assert band(ngram_join.lower_size(b, similar)) <= band(a) <= band(b)
            assert ngram_join.differ(a + b, similar) < max(1, words[band(a)])


# ---- hexadecimal runs of the secret scan


def test_hex_runs_like_a_plain_search():
    rng = random.Random(6)
    plain = re.compile("[0-9a-f]{24,}")
    for _ in range(4000):
        text = "".join(rng.choice("0af") * rng.choice([1, 1, 2, 5, 23, 24, 25, 40]) + rng.choice(["", "", "x", " ", "A", "é", "𝔸"]) for _ in range(rng.randrange(12)))
        assert list(secret_scan.hex_runs(text)) == [m.span() for m in plain.finditer(text)]


# ---- filter audit

DOCS = [
    (1, "plain " * 250, "web"),
    (2, "plain " * 250, None),
    (3, " ".join(f"w{i}" for i in range(300)), "web"),
    (4, "Mixed CASE words # here", "é"),
    (5, None, "web"),
    (6, "", ""),
    (7, " ".join(f"w{i}" for i in range(300)), "web"),
    (None, " ".join(f"w{i}" for i in range(300)), "web"),
    (8, "A" * 1000 + " " + " ".join(f"v{i}" for i in range(250)), "é"),
    (8, "A" * 1000 + " " + " ".join(f"v{i}" for i in range(250)), "é"),
    (9, "x " * 30_000 + "|", "web"),
]
LABELS = [(1, 1, 1), (3, 1, 0), (3, None, None), (4, 0, 1), (7, 1, 1), (8, 1, 0), (77, 1, 1), (None, 1, 1)]


def brute_audit(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    rows = []
    for d, t, source in docs:
        t, w = t or "", WORD.findall(t or "")
        fails = [
            len(w) < 200,
            100 * len(set(w)) < 50 * len(w),
            100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search(r"[#$%&*|]", t)),
            d is not None and first[t] < d,
        ]
        of = [x for x in labels if d is not None and x[0] == d]
        rows.append((source or "", fails, any(x[1] == 1 for x in of), any(x[2] == 1 for x in of)))
    out = {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations(range(5)):
            for step in range(5):
                kept = removed = redundant = unique = good = toxic = 0
                for _, fails, g, x in (r for r in rows if r[0] == part):
                    gone = any(fails[f] for f in order[:step])
                    here = fails[order[step]]
                    kept += not gone and not here
                    removed += here and not gone
                    redundant += here and gone
                    unique += here and sum(fails) == 1
                    good += here and not gone and g
                    toxic += here and not gone and x
                out[part, "".join("ABCDE"[f] for f in order), step + 1] = [kept, removed, redundant, unique, good, toxic]
    shapley = {}
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_filter_audit_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, "clash", True) for r in DOCS], "doc_id long, text string, source string, part string, A boolean").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels)
    assert records(got) == brute_audit(DOCS, LABELS)
    empty = spark.createDataFrame([], docs.schema)
    assert filter_audit.filter_audit(empty, labels).count() == 0
    assert records(filter_audit.filter_audit(docs, spark.createDataFrame([], labels.schema))) == brute_audit(DOCS, [])


def test_filter_audit_of_other_filters(spark):
    flags = spark.createDataFrame([("p", True, False, False, True), ("p", True, True, True, False), ("p", False, False, True, True)], "part string, X boolean, Y boolean, good boolean, toxic boolean")
    got = records(filter_audit.replay(flags, "XY").drop("good_lost", "toxic_lost"))
    assert got == [("p", "XY", 1, 1, 2, 0, 1, 3), ("p", "XY", 2, 1, 0, 1, 0, 1), ("p", "YX", 1, 2, 1, 0, 0, 1), ("p", "YX", 2, 1, 1, 1, 1, 3)]
    with pytest.raises(ValueError):
        filter_audit.replay(flags, "ABCDEFGH")


# ---- prefix trie


def turns_table():
    rng = random.Random(5)
    words = ["a", "b", "é", "", None]
    out = []
    for c in [*range(0, 43), 100, 103, 104, 201, 202, -3, -5]:
        for t in rng.sample(range(12), rng.randrange(1, 12)):
            out.append((c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(words)))
    out += [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "system", "tie"), (None, 1, "user", "nobody")]
    for c in (300, 305, 310, 315):  # long copies: the shared part takes several rounds
        out += [(c, t, "user", f"same {t}") for t in range(61 if c < 310 else 40)]
    out += [(305, 99, "user", "own end")]
    rng.shuffle(out)
    return out


def brute_trie(convs):
    """convs: conv_id -> list of (role, text)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, rows = {}, []
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def fold(path):
        leaves = saved = 0
        for child in children.get(path, []):
            more = totals[child]
            leaves, saved = leaves + more[0], saved + more[1]
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        return (leaves or 1, saved + own)

    totals = {}
    for path in sorted(members, key=len, reverse=True):
        totals[path] = fold(path)
    for path, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        rows.append((min(of), len(path), parent, len(of), len(children.get(path, [])), *totals[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: r[:2])


def brute_turns(table):
    out = {}
    for c in {r[0] for r in table} - {None}:
        own = [(t is not None, t or 0, r or "", x or "") for k, t, r, x in table if k == c]
        own.sort(key=lambda v: (v[0], v[1], hashlib.sha256(f"{len(v[2])}:{v[2]}{v[3]}".encode()).hexdigest()))
        out[c] = [(v[2], v[3]) for v in own]
    return out


def brute_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(*r, 5, "clash") for r in turns_table()], "conv_id long, turn long, role string, text string, depth int, key string").repartition(6)


def test_prefix_trie_against_brute_force(conversations):
    turns = conversation_trie.numbered(conversations)
    want = brute_turns(turns_table())
    assert trie_rows(conversation_trie.prefix_trie(*conversation_trie.as_they_are(turns))) == brute_trie(want)
    assert trie_rows(conversation_trie.prefix_trie(*conversation_trie.rebuilt(turns))) == brute_trie(brute_rebuilt(want))


def test_prefix_trie_small_rounds(conversations, monkeypatch):
    """Rounds of one turn: classes are split turn by turn, and a conversation is spread over ranges."""
    monkeypatch.setattr(conversation_trie, "FIRST_TURNS", 1)
    monkeypatch.setattr(conversation_trie, "MOST_TURNS", 4)
    turns = conversation_trie.numbered(conversations.filter("conv_id >= 300 or conv_id < 6"))
    want = brute_turns([r for r in turns_table() if r[0] is not None and (r[0] >= 300 or r[0] < 6)])
    assert trie_rows(conversation_trie.prefix_trie(*conversation_trie.rebuilt(turns))) == brute_trie(brute_rebuilt(want))


def test_one_conversation_over_many_ranges(spark):
    table = [(1, t, "user", f"turn {t}") for t in range(3000)] + [(2, t, "user", f"turn {t}") for t in range(3)]
    turns = conversation_trie.numbered(spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(8))
    got = turns.orderBy("conv_id", "pos").select("conv_id", "pos").collect()
    assert [tuple(r) for r in got] == [(1, t + 1) for t in range(3000)] + [(2, t + 1) for t in range(3)]


def test_prefix_trie_of_nothing(spark, conversations):
    turns = conversation_trie.numbered(spark.createDataFrame([], conversations.schema))
    assert conversation_trie.prefix_trie(*conversation_trie.rebuilt(turns)).count() == 0
    # one conversation that loses all its turns keeps the root
    lone = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    turns = conversation_trie.numbered(spark.createDataFrame([(lone, 0, "user", "x", 1, "k")], conversations.schema))
    assert trie_rows(conversation_trie.prefix_trie(*conversation_trie.rebuilt(turns))) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_prefix_trie"])
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = corpus.QUERIES[name](spark, SF).toPandas(), con.execute(corpus.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted_rows(got) == sorted_rows(want)
