"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.llm import (
    ann,
    decontaminate,
    line_dedup,
    mixing,
    near_dedup,
    secret_scan,
    sharding,
    token_counts,
    toxicity,
    warc,
)

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one word"), (4, "one word"), (None, "no id"), (None, None), (5, LONG)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_of(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


# --- secret scan -----------------------------------------------------------------------------


def plain_findings(text):
    text = text or ""
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    )
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [
        (m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16
    ]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [x for *_, x in sorted(found)]


def test_secrets_base_is_exact_and_stays(spark, docs):
    rng = random.Random(5)
    rows = list(ODD)
    for i in range(10, 210):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        other = "".join(rng.choice("ghijklmnopqrstuvwxyz") for _ in range(8)) + ".example.com/" + str(rng.randint(10**6, 10**7))
        kind = i % 4
        text = [f'é Ünï token = "{value}" end', f"card {other} x", f"AKIA{value[:14].upper()} é", f"PASSWORD: {value[:7]}"][kind]
        rows.append((i, text))
    rows += [(900, "ſecret=abcdefghij toKen=abcdefghij"), (901, f"x{'0' * 31} {'a' * 33}")]
    got = secret_scan.scan(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    want = Counter((i, tuple(plain_findings(t))) for i, t in rows)
    seen = Counter()
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        base = [x for x in spans if not x.startswith("net")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex, r.n_net] == [
            sum(x.startswith(k) for x in spans) for k in ("assign", "access", "hex", "net")
        ]
        seen[r.doc_id, tuple(base)] += 1
    assert seen == want


def test_secrets_network_holds_out(spark, docs):
    """Held-out recall of the network at its thresholds, and few false alarms."""
    rng = random.Random(6)

    def secret():
        return "".join(rng.choice("0123456789abcdef") for _ in range(40))

    rows = [(i, f"say token = {secret()} now" if i % 2 else f"mail un.{rng.randint(10, 99)}@x{rng.randint(100, 999)}.example.com") for i in range(800)]
    found = secret_scan.extract(docs(rows)).select(F.explode("words").alias("w")).select("w.*")
    net = secret_scan.learn(found)
    fresh = [("my token ", secret(), " ") for _ in range(200)]
    clean = [("write to un.", f"{rng.randint(10, 99)}@x{rng.randint(100, 999)}.example.com"[3:], "") for _ in range(200)]

    def flagged(rows):
        z = secret_scan._highest(net, rows)
        p = 1 / (1 + np.exp(-(net.slope * z + net.shift)))
        return np.mean([a >= net.thresholds[secret_scan.group_of(w)] for a, (_, w, _) in zip(p, rows, strict=True)])

    assert flagged(fresh) >= 0.9
    assert flagged(clean) <= 0.05


def test_secrets_learn_from_all_candidates(spark, docs, monkeypatch):
    """Parts together see every window once a pass, and all held-out candidates set the thresholds, also far into a long word."""
    rng = random.Random(9)
    rows = [
        (f"token {i} ", "".join(rng.choice("0123456789abcdef") for _ in range(40)), " ", True) if i % 2
        else ("see ", f"v{i}." + "".join(rng.choice("ghijklmnop") for _ in range(30)) + ".example", "", False)
        for i in range(3000)
    ]
    rows.append(("say ", "x1" * 200 + "".join(rng.choice("0123456789abcdef") for _ in range(600)), "", True))
    found = spark.createDataFrame(rows, "before string, word string, after string, held boolean")
    windows = {(bytes(s), bytes(t), int(h)) for b, w, a, h in rows for x, y in [(b, a)] + [("", "")] * h for s, t in secret_scan.encode(x, w, y)}
    got = secret_scan._windows(found).collect()
    assert len(got) == len(windows) and {(bytes(r.symbols), bytes(r.traits), r.truth) for r in got} == windows
    counted = []
    plain = secret_scan._logit_counts
    monkeypatch.setattr(secret_scan, "_logit_counts", lambda *a: counted.extend(plain(*a)) or counted)
    net = secret_scan.learn(found, 1024)
    aside = found.where("pmod(xxhash64(before, word, after), 10) < 3")
    assert sum(r.n for r in counted) == aside.count() + aside.where("held").count()
    z = secret_scan._highest(net, [r[:3] for r in rows])
    p = 1 / (1 + np.exp(-(net.slope * z + net.shift)))
    verdict = np.array([a >= net.thresholds[secret_scan.group_of(r[1])] for a, r in zip(p, rows, strict=True)])
    truth = np.array([r[3] for r in rows])
    assert verdict[truth].mean() >= 0.95 and verdict[~truth].mean() <= 0.05


def test_secrets_reads_long_candidates_whole(spark):
    word = "z" * 500 + "0123456789abcdef" * 4
    covered = "".join(
        "".join(c for c, t in zip(range(len(s)), t, strict=True) if t & 1) if False else "x" * sum(v & 1 for v in t)
        for s, t in secret_scan.encode("", word, "")
    )
    assert len(covered) >= len(word)


# --- sharding --------------------------------------------------------------------------------


def test_shards_split_hot_keys_and_repeated_rows(spark, docs):
    rows = [(7, "x" * 10)] * 300 + [(7, "y" * 8 + str(i)) for i in range(100)] + [(i, "z" * 50) for i in range(100, 150)]
    rows += ODD[:-1] + [(5, "w" * 5000)]
    got = sharding.assign_shards(docs(rows, extra=True), limit=200)
    assert "score" in got.columns
    shards = got.groupBy("shard").agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count("*").alias("n"),
        F.max("shard_bytes").alias("mb"), F.max("shard_rows").alias("mn"), F.max("shard_bits").alias("bits"),
    ).collect()
    assert sum(r.n for r in shards) == len(rows)
    names = sorted(r.shard for r in shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # a prefix code
    for r in shards:
        assert (r.b <= 200 or r.n == 1) and r.b == r.mb and r.n == r.mn and r.bits == len(r.shard)


def test_shards_of_an_empty_table(spark, docs):
    assert sharding.assign_shards(docs([])).count() == 0


# --- near duplicates -------------------------------------------------------------------------


def brute_classes(rows):
    """Least doc_id of the component of each row, comparing all pairs."""
    sets = [runs_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            both = len(sets[i] & sets[j])
            if same or (both and both >= 0.8 * len(sets[i] | sets[j])):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return Counter((d, min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows))


def family(rng, count, edits):
    base = [f"t{rng.randint(0, 10**9)}" for _ in range(150)]
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("few", [12, 1])
def test_near_duplicates_equal_brute_force(spark, docs, monkeypatch, few):
    """``few`` of 1 sends every bucket through the block comparison, in several blocks."""
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "BLOCK", 512 if few > 1 else 16)
    rng = random.Random(11)
    texts = family(rng, 60, 8) + family(rng, 3, 1) + [" ".join(f"s{rng.random()}" for _ in range(30)) for _ in range(20)]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + list(ODD)
    got = near_dedup.near_duplicates(docs(rows, extra=True)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == brute_classes(rows)


def test_keep_one_keeps_columns_and_one_row(spark, docs):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (3, "x y z"), (None, "x y z"), (None, None)]
    df = docs(rows, extra=True)
    got = near_dedup.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [
        (0, ""), (0, "x y z"), (1, "a b c d e f"), (3, "x y z")
    ]
    assert near_dedup.keep_one(docs([])).count() == 0


def test_keep_one_where_an_id_has_several_texts(spark, docs):
    rows = [
        (0, "a b c d e f"),
        (1, "a b c d e f"),
        (1, "a wholly other text of some words"),
        (2, "p q r s t u"),
        (2, "second unique text with its words"),
        (3, "p q r s t u"),
        (3, "p q r s t u"),
        (4, LONG),
        (4, LONG + " end"),
        (None, "a b c d e f"),
        (None, "only without an id here now"),
        (None, "only without an id here now"),
    ]
    got = [(r.doc_id, r.text) for r in near_dedup.keep_one(docs(rows, extra=True)).collect()]
    long = [g for g in got if g[0] == 4]
    assert len(long) == 1
    assert Counter(g for g in got if g[0] != 4) == Counter([rows[0], *rows[2:5], *rows[9:]])


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 2**63, 360).astype(np.uint64)
    sets = [x[:300], x[60:]]
    weights = [rng.uniform(0.2, 5, 300) for _ in sets]
    a, b = (dict(zip(s, w, strict=True)) for s, w in zip(sets, weights, strict=True))
    keys = set(a) | set(b)
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    sig = near_dedup.dart_signatures(np.concatenate(sets), np.concatenate(weights), np.array([300, 300]), 4000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04
    empty = near_dedup.dart_signatures(np.zeros(0, np.uint64), np.zeros(0), np.array([0]), 8)
    assert not empty.any()


# --- token counts ----------------------------------------------------------------------------


def test_token_counts_tile_and_rules(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    rows = [*ODD, (20, "hé\nwörld  x\n\n"), (21, "日本\n語 <|endoftext|>\r\nend"), (22, "\n\n a\n")]
    ranks = token_counts.read_ranks(spark, token_counts.RANKS)
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for rule in token_counts.RULES:
        got = token_counts.token_counts(docs(rows, extra=True), rule=rule).toPandas()
        sums = got.groupby(got.doc_id.fillna(-1)).agg(t=("tokens", "sum"))
        want = Counter()
        for i, t in rows:
            want[-1 if i is None else i] += len(enc.encode_ordinary(t or ""))
        for i, n in want.items():
            assert abs(sums.t[i] - n) < 1e-6, (rule, i)
        # brute force of the first rule: character by character
        if rule == "first":
            for i, t in rows[-3:]:
                owner, at = [], 0
                for k in enc.encode_ordinary(t):
                    data = enc.decode_single_token_bytes(k)
                    owner.append(len(t.encode()[: at + 1].decode(errors="ignore") or "") - (0 if (t.encode()[at + 1 : at + 2] or b"a")[0] & 0xC0 == 0x80 else 1))
                    at += len(data)
                for r in got[got.doc_id == i].itertuples():
                    assert r.tokens == sum(r.start <= c < r.end for c in owner)


# --- mixing ----------------------------------------------------------------------------------


def brute_targets(rows):
    size = Counter()
    for r in rows:
        size[r[2] if len(r) > 2 else None] += len(words_of(r[1]))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, held = sum(size.values()), set()
    while True:
        free = [s for s in order if s not in held]
        left = total - sum(3 * size[s] for s in held)
        goal = {s: left * weight[s] / sum(weight[q] for q in free) for s in free}
        above = {s for s in free if goal[s] > 3 * size[s]}
        if not above:
            return {s: goal.get(s, 3.0 * size[s]) for s in order}, size
        held |= above


def test_mixing_meets_targets(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "ä", "Z", None])) for i in range(4000)]
    rows += [(5000 + i, "only few words", "tiny") for i in range(3)] + [(i, t, "a") for i, t in ODD]
    got = mixing.mixed(docs(rows, extra=True)).collect()
    again = mixing.mixed(docs(rows, extra=True).repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    goal, size = brute_targets(rows)
    source = {}
    for i, (d, t, *s) in enumerate(rows):
        source.setdefault((d, len(words_of(t))), set()).add(s[0] if s else None)
    taken, largest = Counter(), max(len(words_of(r[1])) for r in rows)
    for r in got:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        names = [s for s in source[r.doc_id, r.size] if abs(goal[s] - r.target) < 1e-6 and size[s] == r.source_size]
        assert names
        taken[names[0]] += r.taken
    for s, n in goal.items():
        # one document of a source is left open at the end
        assert abs(taken[s] - n) <= largest
    assert mixing.mixed(docs([])).count() == 0


def test_pivotal_rounding_keeps_words(spark):
    import pandas as pd

    rng = np.random.default_rng(0)
    n = 500
    frame = pd.DataFrame({"number": range(n), "doc_id": range(n), "sid": 1, "size": rng.integers(1, 50, n), "whole": 1, "part": rng.uniform(0, 1, n), "node": 0})
    out = pd.concat(mixing._settle(0, False)(iter([frame[:200], frame[200:]])))
    assert abs((out.part * out["size"]).sum() - (frame.part * frame["size"]).sum()) < 1e-6
    assert ((out.part > 0) & (out.part < 1)).sum() <= 1


# --- nearest neighbours ----------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    x[3000:3400] = x[40]  # one vector that very many rows share
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(7000, None, 0), (7020, [0.0] * 64, 0), (7040, [float("nan")] * 64, 0), (7060, [None] * 64, 0), (7080, [1.0], 0), (None, x[0].tolist(), 0), rows[5]]
    got = ann.neighbours(vectors(spark, rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    assert set(by) == set(range(0, 6000, 20))
    d = x.astype(float)
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and q not in {r.vec_id for r in found}
        keys = [(-r.score, r.vec_id) for r in found]
        assert keys == sorted(keys)
        s = d @ d[q]
        s[q] = -9
        hits += len({*np.lexsort((np.arange(6000), -s))[:20].tolist()} & {r.vec_id for r in found})
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in found)
    assert hits / (20 * len(by)) >= 0.9
    hot = [r.vec_id for r in by[40]]
    assert hot == list(range(3000, 3020))


def test_ann_is_exact_with_a_crowd_of_near_equal_vectors(spark):
    rng = np.random.default_rng(5)
    n = 16_384
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    crowd = np.arange(n) % 3 == 1
    x[crowd] = x[1] + 0.1 * rng.normal(size=(crowd.sum(), 64)) / 8
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    got = defaultdict(dict)
    for r in ann.neighbours(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), every=64).collect():
        got[r.query_id][r.rank] = r.vec_id
    assert set(got) == set(range(0, n, 64))
    d = x.astype(float)
    for q, found in got.items():
        s = (d * d[q]).cumsum(axis=1)[:, -1]
        s[q] = -9
        assert [found[k] for k in range(1, 21)] == np.lexsort((np.arange(n), -s))[:20].tolist()


def test_ann_is_exact_where_vec_ids_stand_at_several_vectors(spark):
    """Every vec_id at six vectors, and one at a third of the rows: all its rows are queries, none its neighbour."""
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(2400, 16)) * np.exp(rng.normal(size=(2400, 1)))).astype(np.float32).astype(float)
    x[7] = x[0]
    ids = np.array([20 if i % 3 == 0 else i % 400 for i in range(2400)])
    got = defaultdict(list)
    for r in ann.neighbours(vectors(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)]), least=64).collect():
        got[r.query_id].append((r.rank, -r.score, r.vec_id))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        best = []
        for v in x[ids == q]:
            s = (x * v).cumsum(axis=1)[:, -1]
            best += sorted(zip(-s[ids != q], ids[ids != q], strict=True))[:20]
        assert [(s, i) for _, s, i in sorted(found)] == sorted(best)[:20]


def test_ann_small_and_empty(spark):
    assert ann.neighbours(vectors(spark, [])).count() == 0
    got = ann.neighbours(vectors(spark, [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (20, [0.0, 2.0], 0)])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]


# --- decontamination -------------------------------------------------------------------------


def test_items_of_one_id_in_several_parts(spark, docs, monkeypatch):
    """One item is there as it is, one with other numbers: the answer does not depend on the parts."""
    words = "the tall engine of the old mill turned slowly for"
    items = spark.createDataFrame([(9, f"{words} 40 days"), (9, "a green boat left the quiet harbour before dawn with its crew")], "item_id long, text string")
    rows = docs([(1, f"so {words} 77 days and a green boat left the quiet harbour before dawn with its crew"), (2, "none of it")])
    seen = set()
    for size in (decontaminate.PART_BYTES, 90, 60, 40, 20):
        monkeypatch.setattr(decontaminate, "PART_BYTES", size)
        seen.add(tuple(sorted(tuple(r) for r in decontaminate.contaminated(rows, items).collect())))
    assert seen == {((1, True, "9", "9"), (2, False, "", ""))}


def test_decontamination_templates(spark, docs, monkeypatch):
    item = "zero Alice has 12 apples and Alice buys 5 km of long rope from the old shop today"
    bench = spark.createDataFrame([(9, item), (8, None), (7, ""), (None, item), (6, "Tiny four word item")], "item_id int, text string")
    rows = [
        (10, f"before that {item} and after"),
        (11, "well " + item.replace("Alice", "Bob").replace("12", "30").replace("5", "7")),
        (12, "no zero Bob has 30 apples today but nothing else of it is here"),
        (13, "we say tiny, four word item!"),
        *ODD,
    ]
    for size in (decontaminate.PART_BYTES, 40):
        monkeypatch.setattr(decontaminate, "PART_BYTES", size)
        got = decontaminate.contaminated(docs(rows, extra=True), bench).collect()
        assert len(got) == len(rows)
        found = {r.doc_id: (r.item_ids, r.changed_ids) for r in got if r.contaminated}
        assert found == {10: ("9", ""), 11: ("9", "9"), 13: ("6", "")}
    df = docs(rows, extra=True)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert decontaminate.contaminated(docs(rows), bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize(
    "item",
    [
        "What is the capital of France",
        "Name the long river that runs from the south to the north of Egypt",
        "12 km 7 kg 30 s",
        "Paris",
        "1 Mars 2 Venus 3 Saturn 4 Pluto 5 Jupiter 6 Uranus",
    ],
)
def test_exact_copies_are_found_wherever_they_stand(spark, docs, item):
    bench = spark.createDataFrame([(5, item)], "item_id int, text string")
    rows = [
        (1, f"A heading\n\n{item}"),
        (2, f"we were asked {item} and went on."),
        (3, f"It ends. {item}"),
        (4, item),
        (6, " ".join(["Berlin", *item.split()[1:]])),
        (7, f"they said Berlin {' '.join(item.split()[1:-1])} to us 9 cm 8 g 20 h"),
    ]
    got = {r.doc_id: (r.item_ids, r.changed_ids) for r in decontaminate.contaminated(docs(rows), bench).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [("5", "")] * 4
    if len(item.split()) <= 8:  # one window: another first word is another question
        assert got[6] == ("", "") and got[7] == ("", "")


def test_slots_must_agree():
    """One slot value of the item may not stand for two values of the document."""
    item = "Q says Alice met Alice then Alice left Alice home and Alice ate and Alice slept"
    index, sizes, content, names = decontaminate.template_windows([(1, item)])
    search = decontaminate._search(index, sizes, content, names)
    import pyarrow as pa

    def found(text):
        batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text])], ["row", "text"])
        return next(iter(search(iter([batch])))).column("items").to_pylist()[0]

    assert found(item.replace("Alice", "Eve")) == [1]
    names_ = iter(["Eve", "Bob", "Kim", "Jon", "Ann", "Tom"])
    assert found(re.sub("Alice", lambda _: next(names_), item)) == []


# --- line dedup ------------------------------------------------------------------------------


def edited(rng, text, count):
    b = list(text)
    for _ in range(count):
        k = rng.randrange(len(b))
        o = rng.random()
        if o < 0.3:
            b.insert(k, rng.choice("abz"))
        elif o < 0.6:
            b.pop(k)
        else:
            b[k] = rng.choice("abz")
    return "".join(b)


def test_edit_distance_is_exact_up_to_the_bound(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(6, 30)))
        rows.append((a, edited(rng, a, rng.randint(0, 4))))
    df = spark.createDataFrame(rows, "a string, b string").where("length(a) > 4 AND length(b) > 4")
    for k in (1, 2, 4):
        bad = df.where(line_dedup.edit_distance(F.col("a"), F.col("b"), k) != F.least(F.levenshtein("a", "b"), F.lit(k + 1)))
        assert bad.count() == 0


@pytest.mark.parametrize("crowd, letters", [(6, 12), (1, 12), (1, 1), (0, 0)])
def test_line_links_equal_brute_force(spark, docs, monkeypatch, crowd, letters):
    """Bounds of 1 send nearly every segment through the splits by segments and by letters, 0 all of them."""
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "CROWD_LETTERS", letters)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghé ") for _ in range(rng.randint(18, 40))) for _ in range(30)]
    lines = [edited(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(400)]
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(100)] + list(ODD)
    df = docs(rows, extra=True)
    got = {r.id: r for r in line_dedup.line_classes(df).collect()}
    named = {r.line: r.id for r in line_dedup.lines_of(df).select("line", "id").distinct().collect()}
    assert set(got) == set(named.values())
    distinct = spark.createDataFrame([(x,) for x in named if 20 <= len(x) < 1000], "l string")
    pairs = (
        distinct.alias("p").join(distinct.alias("q"), F.expr("p.l < q.l AND levenshtein(p.l, q.l) <= 2"))
        .select(F.col("p.l").alias("a"), F.col("q.l").alias("b")).collect()
    )
    degree, parent = Counter(), {x: x for x in named}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
        parent[find(a)] = find(b)
    place = defaultdict(list)
    for d, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            if x:
                place[x].append((d is not None, d or 0, n))
    head = defaultdict(list)
    for x in named:
        head[find(x)] += place[x]
    for x, i in named.items():
        r = got[i]
        assert (r.links, r.copies) == (degree[x], len(place[x]))
        assert (r.doc_id is not None, r.doc_id or 0, r.line_no) == min(place[x])
        assert (r.class_doc_id is not None, r.class_doc_id or 0, r.class_line_no) == min(head[find(x)])


def test_line_links_in_a_crowd_meet_few(spark, docs):
    """400 lines with one word of a common line replaced, and a typing error in every 40th: no pair per two of them."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(14)]
    lines = []
    for i in range(400):
        new = list(words)
        new[rng.randrange(14)] = "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
        lines.append(" ".join(new))
    wanted = {(x, edited(rng, x, 1)) for x in lines[::40]}
    df = line_dedup.lines_of(docs([(i, x) for i, x in enumerate(lines + [y for _, y in wanted])]))
    named = {r.line: r.id for r in df.select("line", "id").collect()}
    pairs = {(r.a, r.b) for r in line_dedup.candidates(df).collect()}
    assert {tuple(sorted((named[x], named[y]))) for x, y in wanted if x != y} <= pairs
    assert len(pairs) < 4_000  # of 84,000


def test_lines_of_one_letter_sum_meet_once_per_key(spark, docs):
    """200 lines of the same words in other orders: equal letters, so they met under every sum before."""
    rng = random.Random(11)
    words = [f"{c}{c}x{c}yz" for c in "abcdefghijklmn"]
    head = "".join(rng.choice("abcdefghijklmnop") for _ in range(60))
    lines = sorted({head + " ".join(rng.sample(words, 14)) for _ in range(200)})
    rows = spark.createDataFrame([(i, x, i + 1, 0, 1, len(head)) for i, x in enumerate(lines)], "id long, line string, key long, less int, at long, size long")
    rows = rows.withColumn("key", F.lit(1).cast("long"))
    crowded = rows.select("key").distinct()
    same = F.struct(F.lit(0).cast("long").alias("letters"), F.lit(0).cast("long").alias("pairs"))
    sides = [line_dedup._split(rows, crowded, posted, 2, True).withColumn("odd", same) for posted in (True, False)]
    assert line_dedup._meet(*sides, 2).count() == len(lines) * (len(lines) - 1)


def test_line_members_name_every_line(spark, docs):
    long_ = "this line is long enough to count"
    rows = [(1, f"{long_}\nshort"), (2, f"{long_}!\nshort\n{long_}"), (3, None), (4, f"\n{long_}")]
    got = sorted(tuple(r) for r in line_dedup.line_members(docs(rows)).collect())
    assert got == [
        (1, 0, 3, 1, 1, 0), (1, 1, 2, 0, 1, 1), (2, 0, 1, 1, 1, 0), (2, 1, 2, 0, 1, 1), (2, 2, 3, 1, 1, 0), (4, 1, 3, 1, 1, 0),
    ]


def test_keep_first_lines(spark, docs):
    long_ = "this line is long enough to count"
    rows = [(1, f"{long_}\nshort"), (2, f"{long_}!\nshort\nnew"), (3, None), (None, "")]
    got = {r.doc_id: (r.text, r.lines, r.kept) for r in line_dedup.keep_first(docs(rows)).collect()}
    assert got == {1: (f"{long_}\nshort", 2, 2), 2: ("new", 3, 1), 3: ("", 0, 0), None: ("", 0, 0)}


# --- toxicity --------------------------------------------------------------------------------


def test_toxicity_learns_and_leaves_held_out_rows(spark, docs):
    rng = random.Random(8)
    bad, plain = ["scoundrelish", "vermincake", "slimeface"], [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(40)]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(4):
                w[rng.randrange(40)] = rng.choice(bad) + rng.choice(["", "!", "."])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    rows += [(i and i + 5000, t) for i, t in ODD]
    labels += [(None, 1, 1), (5004, None, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(rows, extra=True), lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    # labels of held-out rows change nothing
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.toxicity(docs(rows, extra=True), flipped).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, other))
    none = toxicity.toxicity(docs(rows[:5]), lab.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.toxicity(docs([]), lab).count() == 0


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in (0.9, 0.8, 0.7, 0.65)], 1)
    votes = np.column_stack([votes, votes[:, 3], votes[:, 3]]).astype(np.int8)  # three copies of one voter
    posterior, accuracy, corr = toxicity.label_model(votes, 0.3)
    assert abs(accuracy[:3] - [0.9, 0.8, 0.7]).max() < 0.08
    assert corr[3, 4] > 0.9 and abs(corr[0, 1]) < 0.3
    assert ((posterior > 0.5) == y).mean() > 0.88


# --- web archives ----------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [
        (1, "http://www.a.example.com/x?y=1#z", "<p>é</p>\r\n\r\nWARC/1.1\r\n"),
        (2, "https://b.example.org:8080/", "<p>é</p>\r\n\r\nWARC/1.1\r\n"),
        (3, None, None),
        (4, "not a url\r\nWARC-Type: x", ""),
        (5, "http://a.example.com/x?y=1", "five"),
        (None, "http://c/", "five"),
        (None, "http://d/", "six"),
        (6, "http://b.example.org/", "big" * 400_000),
        (7, "http://a.example.com/x?y=1", "tie"),
        (7, "http://a.example.com/x?y=1", "tie"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("x"))
    got = warc.archive(pages, f"file://{tmp_path}/w").collect()
    last = defaultdict(lambda: None)
    for p, _, h in rows:
        if p is not None:
            last[h or ""] = max(p, last[h or ""] or 0)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        kept = last[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((p, len(data), digest, *(("response", None) if p == kept else ("revisit", kept))))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) for r in got)
    texts = {r.page_id: r.payload.decode() for r in got if r.record_type == "response"}
    assert texts[2] == rows[1][2] and texts[6] == rows[7][2]
    # the files are plain archives: gzip members, each one record
    import glob
    import gzip

    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/w/archives/part-*"))
    assert whole.count(b"WARC-Record-ID: ") == len(rows)
    one = warc.lookup(spark, f"file://{tmp_path}/w/index", spark.createDataFrame([("http://a.example.com/x?y=1",), ("http://zz/",)], "url string"))
    assert sorted(r.page_id for r in warc.read_records(one).collect()) == [1, 5, 7, 7]


def test_warc_of_an_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(pages, f"file://{tmp_path}/w").count() == 0


def test_index_blocks_and_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 7)
    monkeypatch.setattr(warc, "CAPTURES_PER_PART", 40)
    rows = [(i, f"http://h{i % 5}.example.com/{'hot' if i % 3 == 0 else i}", f"<p>{i % 90}</p>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive(pages, f"file://{tmp_path}/w").collect()
    assert sorted(r.page_id for r in got) == list(range(300))


# --- tables without rows, and files ------------------------------------------------------------


def test_operators_on_empty_tables(spark, docs):
    none = docs([])
    items = spark.createDataFrame([], "item_id long, text string")
    some = docs([(1, "a text of a few plain words that nobody asked for")])
    assert secret_scan.scan(none).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert line_dedup.line_classes(none).count() == 0
    assert decontaminate.contaminated(none, items).count() == 0
    assert [r.contaminated for r in decontaminate.contaminated(some, items).collect()] == [False]
    assert mixing.mixed(none).count() == 0


def test_shards_as_files(spark, docs, tmp_path):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(200)] + [(None, None), (3, "again")]
    df = docs(rows)
    sharding.write_shards(df, str(tmp_path / "shards"), limit=2_000)
    back = spark.read.option("basePath", str(tmp_path / "shards")).parquet(str(tmp_path / "shards"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    wanted = Counter((r.doc_id, "b" + r.shard) for r in sharding.assign_shards(df, limit=2_000).collect())
    folders = [p for p in (tmp_path / "shards").iterdir() if p.name.startswith("shard=")]
    assert {p.name.removeprefix("shard=") for p in folders} == {s for _, s in wanted} and len(folders) > 3
    for folder in folders:
        name = folder.name.removeprefix("shard=")
        held = spark.read.parquet(str(folder)).collect()
        assert Counter(r.doc_id for r in held) == Counter({i: k for (i, s), k in wanted.items() if s == name})
        assert sum(len((r.text or "").encode()) for r in held) <= 2_000 or len({r.doc_id for r in held}) == 1
