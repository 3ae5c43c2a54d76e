"""The corpus operators against brute-force versions and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomena.llm import chat_format, common, decontaminate, html_extract, line_dedup, mixing, near_dups, pu_quality, quality_rules, secret_scan, sharding

WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "a b c d"), (4, "a b c d"), (None, "x y z x y z"), (5, "é\U0001f600 " * 40), (6, "word " * 3000)]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def with_extras(d):
    return d.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long"), "node": F.lit("x"), "size": F.lit(1), "__t": F.lit(2)})


def secrets_by_hand(t):
    t = t or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    base.sort()
    new = []
    for kind, (_, pattern, least) in enumerate(secret_scan.CLASSES, 3):
        for m in re.finditer(pattern, t):
            if any(re.search(a, m[0]) for a in secret_scan.ALLOWED):
                continue
            w = secret_scan.WINDOW
            hot = [i for i in range(len(m[0]) - w + 1) if round(-sum(c / w * math.log2(c / w) for c in Counter(m[0][i : i + w]).values()), 9) >= least]
            if hot and not any(a <= m.start() + hot[0] and m.start() + hot[-1] + w <= z for a, _, z in base):
                new.append((m.start() + hot[0], kind, m.start() + hot[-1] + w))
    return base, sorted(base + new)


def test_secrets(spark):
    rng = random.Random(5)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    texts = [t for _, t in ODD] + ["token:secret:abcdefghij", "é\U0001f600 Password = 'hunter2hunter2' AKIA" + pick("ABCD0123", 16), "key " + pick("0123456789abcdef", 40) + " x", pick(b64, 44), "a/b " + pick(b64, 25) + "\n" + pick("0123456789ABCDEF", 30), "abcdefghijklmnopqrstuvwxyz0123456789", "11111111111111111111111", "api_key=short", "SECRET: " + pick(b64, 30)]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        base, found = secrets_by_hand(t)
        assert [tuple(x) for x in got[i]["base"]] == base
        assert [tuple(x) for x in got[i]["found"]] == found


def test_quality_rules():
    for _, t in [*ODD, (9, "a b c d e f g\nq w\nq w\na b c d e x y z u v w")]:
        words = WORD.findall(t or "")
        grams = defaultdict(list)
        for i in range(len(words) - 4):
            grams[tuple(words[i : i + 5])].append(i)
        again = {j for x in grams.values() if len(x) > 1 for i in x for j in range(i, i + 5)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            dup += line in seen
            if WORD.search(line):
                seen.add(line)
        n, chars, _, lines, repeat, *_, failed, kept = quality_rules.measure(t)
        assert (n, chars, lines, repeat) == (len(words), sum(map(len, words)), dup, len(again))
        assert failed == (n < 10 or 100 * repeat > 20 * n) and not (failed and kept)


def test_html():
    page = "<html><head><title>T</title><body><nav><a>menu</a></nav><article><h1>A &amp; B</h1><p>one\n two<p>three<div class='comments'>no</div></article><footer>f</footer>"
    assert [x for _, x in html_extract.blocks(page)] == ["A & B", "one two", "three"]
    assert html_extract.blocks(None) == html_extract.blocks("") == []
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 11))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        shared = html_extract.shared_lines(a, b)
        rest = iter(b)
        assert sum(shared) == table[-1][-1] and all(x in rest for x, s in zip(a, shared) if s)


def test_html_differencing(spark):
    page = lambda body: f"<body><p>Welcome here<p>{body}<p>All rights kept"
    rows = [(1, "http://h.x/a/1", page("alpha text")), (2, "http://h.x/a/2", page("beta text")), (3, None, None), (4, "http://h.x/a/2", page("beta text"))]
    got = {r[0]: r[2] for r in html_extract.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "alpha text", 2: "beta text", 3: "", 4: "beta text"}
    assert html_extract.extract(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_html_differencing_beside_articles(spark):
    page = lambda title, text: f"<body><p>Welcome here<article><p>{text}<p>Quoted by both<p>{text} ends</article><p>{title}<p>All rights kept"
    rows = [(1, "http://h.x/a/1", page("alpha notes", "alpha")), (2, "http://h.x/a/2", page("beta notes", "beta"))]
    got = {r[0]: r[2].split("\n") for r in html_extract.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert got == {i: [x, "Quoted by both", f"{x} ends", f"{x} notes"] for i, x in ((1, "alpha"), (2, "beta"))}


def test_html_neighbours_of_a_large_host(spark):
    """The pages of a host that is cut into runs still meet the page before them."""
    rows = [(3 * k + j, f"http://h.x/{k:03}/{j}", f"<p>Section {k}<p>Text {k} {j}<p>End of section {k}") for k in range(100) for j in range(3)]
    got = {r[0]: r[2] for r in html_extract.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 300 and all(got[3 * k + j] == f"Text {k} {j}" for k in range(100) for j in (1, 2))


def test_html_copies_and_long_templates(spark):
    page = lambda *lines: "<p>".join(["", *(f"Template {i}" for i in range(8)), *lines])
    text = [f"long text {i}" for i in range(20)]
    rows = [(i, f"http://a.x/{i}", page(f"only {i}")) for i in range(3)]
    rows += [(10, "http://b.x/0", page(*text, "printed today")), (11, "http://b.x/1", page(*text, "printed later")), (12, "http://b.x/2", page(*(f"other {x}" for x in text)))]
    rows += [(20, "http://c.x/0", page("same")), (21, "http://c.x/1", page("same"))]
    got = {r[0]: r[2].split("\n") for r in html_extract.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == [["only 0"], ["only 1"], ["only 2"]]
    assert got[10] == [*text, "printed today"] and got[11] == [*text, "printed later"] and got[12] == [f"other {x}" for x in text]
    assert len(got[20]) == len(got[21]) == 9


def check_shards(d, rows, shards):
    counts = Counter(r["__shard"] for r in rows)
    assert len(rows) == d and max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r["__slot"] for r in rows if r["__shard"] == s) == list(range(counts.get(s, 0)))


def test_shards(spark):
    rows = [(i, f"t{i // 3}") for i in range(300)] + [(1000 + i, "same") for i in range(200)] + [(None, None)] * 3
    d = frame(spark, rows)
    got = sharding.shard_rows(d, F.coalesce("text", F.lit("")), [F.col("doc_id")]).collect()
    check_shards(503, got, 16)
    cut = sum(len({r["__shard"] for r in got if r["text"] == f"t{i}"}) - 1 for i in range(100))
    assert cut <= 20  # by chance it would be about 180
    assert sharding.shard_rows(d.limit(0), F.col("text"), [F.col("doc_id")]).count() == 0


def test_large_groups_stay_whole(spark):
    """Groups far over rows / 256 that fit a shard stay in one; a larger one is cut no more than it must."""
    rows = [(i, f"g{i // 60}") for i in range(600)] + [(1000 + i, "more than two shards") for i in range(250)] + [(2000 + i, f"single {i}") for i in range(750)]
    got = sharding.shard_rows(frame(spark, rows), F.col("text"), [F.col("doc_id")]).collect()
    check_shards(1600, got, 16)
    shards = defaultdict(set)
    for r in got:
        shards[r["text"]].add(r["__shard"])
    assert all(len(shards[f"g{i}"]) == 1 for i in range(10)) and 3 <= len(shards["more than two shards"]) <= 4


def test_shards_write_few_files(spark, monkeypatch):
    """The tables of the rounds have as many files as their rows ask for, not as a shuffle has partitions: each file makes an executor start processes."""
    files, write = [], sharding.materialize

    def counted(*args, **named):
        out = write(*args, **named)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(sharding, "materialize", counted)
    hot = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in hot}
    try:
        for k, v in hot.items():
            spark.conf.set(k, v)
        got = sharding.shard_rows(frame(spark, [(i, f"t{i // 3}") for i in range(600)]), F.col("text"), [F.col("doc_id")]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    check_shards(600, got, 16)
    assert len(files) >= 8 and max(files) <= spark.sparkContext.defaultParallelism


def near_by_hand(rows, n, p, q):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and both * q >= len(sets[a] | sets[b]) * p:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,p,q", [(3, 9, 10), (5, 4, 5)])
def test_near_groups(spark, n, p, q):
    rng, rows = random.Random(n), []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 7, 30, 120, 400]))]
        for _ in range(rng.choice([1, 3, 45])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, len(w) // 25])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "W1  w2"), (len(rows) + 3, "w1 W2\n")]
    got = {r[0]: (r[1], r[2]) for r in near_dups.near_groups(with_extras(frame(spark, rows)), n, p, q).collect()}
    assert got == near_by_hand(rows, n, p, q)


def test_near_groups_odd_rows(spark):
    assert len(near_dups.near_groups(frame(spark, ODD)).collect()) == len(ODD)
    assert near_dups.near_groups(frame(spark, [])).count() == 0


def test_near_groups_in_blocks(spark, monkeypatch):
    """Signatures of many nodes and clusters of several blocks lose no link, and a group of alike but unlinked texts passes on no pairs."""
    monkeypatch.setattr(near_dups, "FEW", 5)
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 3000)
    monkeypatch.setattr(near_dups, "ROUNDS", 1)
    asked, links = [], near_dups._links_in_blocks
    monkeypatch.setattr(near_dups, "_links_in_blocks", lambda cluster, *rest: (asked.append(cluster.count()), links(cluster, *rest))[1])
    rng, rows, n = random.Random(5), [], 3
    base = [f"w{i}" for i in range(200)]
    for k in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 4, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {r[0]: (r[1], r[2]) for r in near_dups.near_groups(frame(spark, rows), n, 9, 10).collect()}
    assert got == near_by_hand(rows, n, 9, 10) and asked and asked[0] <= len(rows)


def test_pairs_looked_at_are_few_a_node(spark, monkeypatch):
    """Near copies of one text meet many others by their signatures; of these a few a node are looked at in a round, and no link is lost by it."""
    monkeypatch.setattr(near_dups, "LOOKED", 2)
    monkeypatch.setattr(near_dups, "ROUNDS", 1)
    seen, salted = [], near_dups._salted
    monkeypatch.setattr(near_dups, "_salted", lambda rows, small, key, spread: (seen.append((key, rows.count())), salted(rows, small, key, spread))[1])
    rng, rows, n = random.Random(6), [], 3
    for k in range(80):
        w = [f"w{i}" for i in range(150)]
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {r[0]: (r[1], r[2]) for r in near_dups.near_groups(frame(spark, rows), n, 9, 10).collect()}
    assert got == near_by_hand(rows, n, 9, 10)
    assert next(m for key, m in seen if key == "a") <= 2 * len(rows)


def joined_rows(spark, since):
    """Rows that all joins have made in the executions from number `since` on; the number of the next one."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, found, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList()
    for e in (runs.apply(i) for i in range(runs.size())):
        if (k := e.executionId()) < since:
            continue
        last, values, nodes = max(last, k + 1), store.executionMetrics(k), store.planGraph(k).allNodes()
        for n in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in n.name():
                told = {n.metrics().apply(i).name(): n.metrics().apply(i).accumulatorId() for i in range(n.metrics().size())}
                if (at := told.get("number of output rows")) is not None and values.contains(at):
                    found += int(values.apply(at).replace(",", ""))
    return found, last


def test_components_look_at_an_edge_once(spark):
    """Joins make rows as there are edges, not as edges times rounds: what is within a component by now goes."""
    rng = random.Random(8)
    few, many = [(k, k + 1) for k in range(10_000, 10_040)], [(rng.randrange(400), rng.randrange(400)) for _ in range(6000)]
    hub, far = [(20_000, 20_001 + k) for k in range(30)] + [(30_000 - k, 40_000) for k in range(30)], [(5, 5), (7777, 7777)]
    edges = few + many + hub + far
    d = common.materialize(spark.createDataFrame(edges, "a long, b long"))
    nodes = spark.createDataFrame([(x,) for x in {x for e in edges for x in e} | {123_456}], "node long")
    _, since = joined_rows(spark, 0)
    got = {r[0]: r[1] for r in near_dups.components(nodes, d).collect()}
    made, _ = joined_rows(spark, since)
    root = {r[0]: r[0] for r in nodes.collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert made <= 3 * len(edges) + 12 * len(root)


def test_forest_joins_what_is_near():
    rng = np.random.default_rng(4)
    for share in (0.0, 0.02, 0.2, 1.0):
        name, near = rng.permutation(80).astype(np.int64), rng.random((30, 50)) < share
        forest, slow = near_dups._Forest(), list(range(80))
        near_dups._join_near(forest, name[:30], name[30:], near)
        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = slow[name[i]], slow[name[30 + j]]
            slow = [a if x == b else x for x in slow]
        assert all((forest.top(a) == forest.top(b)) == (slow[a] == slow[b]) for a in range(80) for b in range(80))
        assert len(forest.edges) < 80


@pytest.mark.parametrize("p, q", [(4, 5), (9, 10)])
def test_spanning_links(p, q):
    """Links found in a block join the same components as all links do."""
    rng = np.random.default_rng(3)
    families = [rng.integers(0, 1 << 63, n, np.int64) for n in (1, 6, 60, 60, 300)]
    sets = []
    for base in families:
        for _ in range(40):
            keep = base[rng.random(len(base)) > 0.08] if len(base) > 1 else base
            sets.append(np.unique(np.r_[keep, rng.integers(0, 1 << 63, rng.integers(0, max(1, len(base) // 12)), np.int64)].view(np.uint64)).view(np.int64))
    sets = [x if len(x) else families[0] for x in sets]

    def joined(links):
        root = list(range(len(sets)))
        for i, j in links:
            root = [root[i] if r == root[j] else r for r in root]
        return [root.index(r) for r in root]

    n = len(sets)
    for left in (None, rng.random(n) > 0.5):
        if left is None:  # all against all
            left = np.ones(n, bool)
            found = [(i, j - n) for i, j in near_dups._spanning(sets * 2, np.tile(np.arange(n), 2), np.arange(2 * n) < n, p, q, once=True)]
        else:
            found = near_dups._spanning(sets, np.arange(n), left, p, q)
        every = []
        for i in range(len(sets)):
            for j in range(len(sets)):
                both = len(np.intersect1d(sets[i], sets[j]))
                if left[i] and (not left[j] or left.all()) and i != j and both * q >= (len(sets[i]) + len(sets[j]) - both) * p:
                    every.append((i, j))
        assert set(found) <= set(every) and joined(found) == joined(every)


def test_line_store_is_reversible(spark):
    docs = [(1, "shared line one\nshort\nonly here 1\nshared line one"), (2, " Shared LINE one\nonly here 2"), (3, "shared line one\nanother shared"), (4, "another shared\nx"), (5, None)]
    store = line_dedup.LineStore(spark, shard_keys=3).insert(frame(spark, docs[:3])).insert(frame(spark, docs[3:]))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in store.dedup(frame(spark, docs)).collect()}
    assert got == {1: (4, 0, docs[0][1]), 2: (2, 1, "only here 2"), 3: (2, 1, "another shared"), 4: (2, 1, "x"), 5: (1, 0, "")}
    less = store.delete(frame(spark, [(1,), (99,)], "doc_id long"))
    fresh = line_dedup.LineStore(spark, shard_keys=3).insert(frame(spark, docs[1:]))
    ask = lambda s: {tuple(r) for r in s.dedup(frame(spark, docs[1:])).collect()}
    assert ask(less) == ask(fresh)
    assert {tuple(r) for r in less.counts.collect()} == {tuple(r) for r in fresh.counts.collect()}


def test_cuckoo_filter():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 62, 20_000)
    f = line_dedup.CuckooFilter(len(keys))
    f.insert(keys)
    f = line_dedup.CuckooFilter(data=f.dump())
    assert f.contains(keys).all() and f.contains(rng.integers(0, 1 << 62, 20_000)).mean() < 0.001
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.01


def test_templates():
    t = chat_format.compile_template("{% for m in ms %}{% if loop.first %}<{% elif loop.last %}>{% else %},{% endif %}{{ m.a | upper }}{{ 1 + 2 }}{% endfor %}")
    assert "".join(x for x, _ in t(ms=iter([{"a": "p"}, {"a": "q"}, {"a": "r"}]))) == "<P3,Q3>R3"
    assert chat_format.fold_body(chat_format.parse("a{{ 'b' ~ 1 }}{% if false %}no{% else %}c{% endif %}")) == [("text", "ab1c")]
    for bad in ("{{ m.__class__ }}", "{{ f() }}", "{% import x %}", "{{ x | open }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(bad)
    for x in ("</s>[INST] ok [/INST]", "<|>", "␛-␛=", "<<SYS>><s", "<"):
        assert chat_format.unescape(chat_format.escape(x)) == x and not any(c in chat_format.escape(x) for c in chat_format.CONTROLS)


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a|>"), (2, 0, ">|<|", None), (None, None, None, "x"), (3, 0, "assistant", "<" * 50)]
    got = {r["conv_id"]: r for r in chat_format.digest_conversations(frame(spark, rows, "conv_id long, turn long, role string, text string")).collect()}
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0)):
        want[c].append((role or "", text or ""))
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_decontamination():
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(15, 50)))) for i in range(40)]
    index, found, due = decontaminate.ItemIndex(items), 0, 0
    for i, t in items:
        w = t.split()
        for _ in range(len(w) // 9):
            w[rng.randrange(len(w))] = "zz"
        text = "foo bar " * 20 + " ".join(w).upper() + " baz" * 9
        if decontaminate.edit_within(t, text.lower(), int(0.2 * len(t))) is not None:
            due += 1
            found += any(x[0] == i for x in index.search([text])[0])
    assert due > 20 and found >= 0.95 * due
    assert index.search([None, "", "foo bar " * 1000]) == [[], [], []]


def test_decontamination_by_letters():
    """One letter changed in many words: few words are intact, the distance in letters is small."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 50)))) for i in range(40)]
    index, texts = decontaminate.ItemIndex(items), []
    for _, t in items:
        w = t.split()
        for j in rng.sample(range(len(w)), len(w) // 2):
            w[j] = "#" + w[j][1:]
        texts.append("foo  bar " * 20 + "\n".join(w).upper() + " baz" * 9)
    for (i, t), found in zip(items, index.search(texts), strict=True):
        assert [(x[0], x[2] <= 0.2 * len(t)) for x in found] == [(i, True)]
    assert index.search([None, "", "foo bar " * 1000]) == [[], [], []]


def edited(text, rate, kind, rng):
    """The text after rate * its length edits of letters (0 substitute, 1 insert, 2 delete) or of words (3 to 5)."""
    letters, left, t = "abcdefghijklmnopqrstuvwxyz", int(rate * len(text)), list(text) if kind < 3 else text.split(" ")
    while True:
        i = rng.randrange(len(t))
        new = "".join(rng.choice(letters) for _ in range(1 if kind < 3 else 4))
        left -= 1 if kind < 3 else (max(4, len(t[i])), 5, len(t[i]) + 1)[kind - 3]
        if left < 0:
            return "".join(t) if kind < 3 else " ".join(t)
        t[i : i + 1] = ([new], [t[i], new], [])[kind % 3]


@pytest.mark.parametrize("kind", range(6))
def test_decontamination_recall(kind):
    """Items edited within a fifth of their letters are found, as exact search over the text finds them."""
    rng = random.Random(kind)
    part = ["the", "on", "re", "in", "an", "ed", "tion", "st", "er", "ou", "le", "ha"]
    words = lambda n: " ".join("".join(rng.choice(part) for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [(i, words(rng.randint(14, 60))) for i in range(40)]
    index = decontaminate.ItemIndex(items)
    for rate in (0.02, 0.05, 0.1, 0.15, 0.19):
        texts = [f"{words(60)} {edited(t, rate, kind, rng)} {words(60)}" for _, t in items]
        due = [{i for i, t in items if decontaminate.edit_within(t, x, int(0.2 * len(t))) is not None} for x in texts]
        found = [{m[0] for m in ms} for ms in index.search(texts)]
        assert all(f <= d for f, d in zip(found, due, strict=True)) and sum(map(len, due)) >= len(items)
        assert sum(map(len, found)) >= 0.95 * sum(map(len, due))


def test_find_items_frames(spark):
    """Several blocks find what one does; nulls, empty texts and items, repeated rows, clashing names, no items."""
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(20))) for i in range(30)] + [(90, None), (91, ""), (92, "  ")]
    rows = [(i, f"x y z {t} x y z") for i, t in items[:30]] + [(3, f"{items[3][1]} {items[4][1]}")] * 2 + [(None, None), (50, ""), (51, "w1 w2 " * 30000)]
    docs = frame(spark, rows).withColumns({"matches": F.lit(1), "item_id": F.lit("x"), "at": F.lit(None)})
    bench = frame(spark, items, "item_id long, text string")
    one = decontaminate.find_items(docs, bench).collect()
    more = decontaminate.find_items(docs, bench, block=7).collect()
    assert sorted(map(str, one)) == sorted(map(str, more)) and len(one) == len(rows)
    assert sorted([m["item_id"] for m in r["matches"]] for r in one if r["matches"]) == sorted([[i] for i in range(30)] + [[3, 4]] * 2)
    assert all(r["matches"] == [] for r in decontaminate.find_items(docs, bench.limit(0)).collect())
    assert decontaminate.find_items(docs.limit(0), bench).count() == 0


def test_pu_classifier(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "over", "stones.", "A", "house", "stands"]) for _ in range(80)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "***", "NOW!!", "$$$"]) for _ in range(80))
    rows = [(i, good() if i % 3 else bad()) for i in range(600)]
    d, labels = frame(spark, rows), frame(spark, [(i, int(i % 3 > 0)) for i in range(0, 600, 2)], "doc_id long, quality int")
    model, prior = pu_quality.train(d, labels)
    assert 0.5 < prior < 0.8
    got = pu_quality.score_docs(d.unionByName(frame(spark, [(None, None), (9999, "")])), model).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum((r["score"] >= 0.7) == (r["doc_id"] % 3 > 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 600) > 590
    assert pu_quality.train(d, labels.limit(0))[0] is None


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)] + [(None, None, "z")]
    d = frame(spark, rows, "doc_id long, text string, source string").withColumns({"n_docs": F.lit(1), "target": F.lit("x"), "size": F.lit(None)})
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""))
    got = mixing.mix(d, words, [F.col("doc_id")], "doc_id").collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r["source"]] += r["__size"]
        taken[r["source"]] += r["__size"] * r["__copies"]
        target[r["source"]] = r["__target"]
        assert 0 <= r["__copies"] <= 3
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, left, open_ = {}, float(sum(size.values())), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
        left, open_ = left - sum(want[s] for s in over), open_ - over
    want |= {s: level * weight[s] for s in open_}
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= max(60, 0.01 * target[s])


def test_mix_inclusion(spark):
    """Over many seeds each document is drawn as often as its probability says, and a class's number is one of the two around its expected one."""
    rows = [(i, 40 + i % 9, "abcd"[i % 4]) for i in range(160)]
    d = frame(spark, rows, "doc_id long, words long, source string").cache()
    n, drawn, p, size = 60, Counter(), {}, {}
    for seed in range(n):
        for r in mixing.mix(d, F.col("words"), [F.col("doc_id")], "doc_id", weights=(5.0, 3.0, 2.0, 1.0), seed=f"s{seed}").collect():
            drawn[r["doc_id"]] += r["__copies"] - int(r["__target"] / r["__source_size"])
            p[r["doc_id"]], size[r["doc_id"]] = r["__p"], r["__size"]
    assert len({round(x, 6) for x in p.values()}) > 8  # unequal
    assert abs(sum(drawn[i] / n - p[i] for i in p)) < 0.02 * len(p)
    off = [(drawn[i] - n * p[i]) / math.sqrt(n * p[i] * (1 - p[i])) for i in p if 0 < p[i] < 1]
    assert max(map(abs, off)) < 4.5 and 0.6 < np.std(off) < 1.2


def test_mix_repeated_rows(spark):
    """Equal rows have one rank: a cut through them takes just as many as are left."""
    rows = [(1, 10, "a")] * 500 + [(None, 10, None)] * 300 + [(i, 10, "b") for i in range(2, 400)]
    d = frame(spark, rows, "doc_id long, words long, source string").withColumn("row", F.monotonically_increasing_id())
    got = mixing.mix(d, F.col("words"), [F.col("doc_id")], "row").collect()
    assert len(got) == len(rows)
    for s in ("a", "b", None):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["__copies"] * 10 for r in mine) - mine[0]["__target"]) <= 10
    assert mixing.mix(d.limit(0), F.col("words"), [F.col("doc_id")], "row").count() == 0


def test_addresses_tell_rows_apart(spark):
    """Rows of files are named in place; what may repeat a file's row is numbered."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    thrice = d.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    for x in (d, d.filter("doc_id > 5").select("doc_id"), thrice, d.unionByName(d), d.join(thrice.select("doc_id"), "doc_id"), d.filter(F.rand() < 2), d.limit(0), frame(spark, ODD)):
        assert common.addressed(x).select("__rid").distinct().count() == x.count()
