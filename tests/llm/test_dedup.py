"""Near-duplicate operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, line_dedup, simhash_dedup, substring_dedup
from lexiloom.llm.common import components, link_buckets, shared_dir

KIND = "doc_id long, text string, lang string"
SYLLABLES = "an the er on in ou ti re ha st ly wh es ed ing or at le".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def edited(rng, ws, changes):
    ws = list(ws)
    for _ in range(changes):
        ws[rng.randrange(len(ws))] = "changed" + rng.choice(SYLLABLES)
    return ws


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(100)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == union(links, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rounds", [0, 2])
def test_link_buckets_loses_no_link(spark, rounds):
    rng = random.Random(5)
    members = sorted({(rng.randrange(12), rng.randrange(400)) for _ in range(700)})
    near = lambda a, b: abs(a - b) <= 3
    got = dict(map(tuple, link_buckets(spark.createDataFrame(members, "key long, id long"), lambda p: p.where("abs(a - b) <= 3"), rounds).collect()))
    per = defaultdict(list)
    for k, i in members:
        per[k].append(i)
    links = [(a, b) for xs in per.values() for a in xs for b in xs if a < b and near(a, b)]
    want = union(links, {x for ab in links for x in ab})
    assert got == want


def test_rare_tokens_lose_no_link(spark):
    """One bucket of near copies: prefix and positional filtering must give the components of all similar pairs."""
    rng = random.Random(6)
    base = [set(rng.sample(range(100), 20)) for _ in range(4)]
    sets = []
    for i in range(120):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.choice([1000 + i, rng.randrange(100), 2000 + rng.randrange(200)]))
        sets.append(s)
    often = Counter(t for s in sets for t in s)
    rows = []
    for i, s in enumerate(sets):
        order = sorted(s, key=lambda t: (often[t], t))
        most = len(s) - -(-len(s) * 8 // 10) + 1
        rows += [(i, t, r, len(s)) for r, t in enumerate(order[:most], 1)]
    table = spark.createDataFrame(rows, "id long, token long, rank int, n int")
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    good = spark.createDataFrame([(a, b) for a in range(120) for b in range(120) if a < b and alike(a, b)], "a long, b long")
    members = spark.range(120).selectExpr("1L AS key", "id")
    got = dict(map(tuple, link_buckets(members, lambda p: p.join(good, ["a", "b"]), 0, lambda ids: ids.join(table, "id").select("id", "c", "token", "rank", "n")).collect()))
    pairs = list(map(tuple, good.collect()))
    assert got == union(pairs, {x for ab in pairs for x in ab})


def test_link_buckets_compares_a_group_of_copies_once_each(spark):
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        return pairs

    members = spark.range(3000).selectExpr("1L AS key", "id")
    assert link_buckets(members, verify).select("component").distinct().count() == 1
    assert sum(seen) == 2999


def simhash_of(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(11)
    base = [words(rng, rng.choice([40, 200, 400])) for _ in range(25)]
    rows = []
    for b in base:
        rows.append(" ".join(b))
        rows += [" ".join(edited(rng, b, rng.choice([0, 1, 2]))) for _ in range(rng.randint(0, 4))]
    rows += [None, "", "  \t ", "one", "One", "one two", "x " * 30000]
    return [(i, t, "en") for i, t in enumerate(rows)] + [(3, rows[3], "en"), (None, rows[0], "en")]


def test_simhash_against_brute_force(spark, documents):
    got = simhash_dedup.near_duplicates(spark.createDataFrame(documents, KIND)).collect()
    assert len(got) == len(documents)
    want = {i: simhash_of(t) for i, t, _ in documents if i is not None}
    links = [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 3]
    classes = union(links, want)
    for r in got:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (want[r.doc_id], classes[r.doc_id])
        else:
            assert r.component_id == classes[0]
    kept = simhash_dedup.keep_one(spark.createDataFrame(documents, KIND))
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted(set(classes.values()))


def test_near_components_of_close_fingerprints(spark):
    rng = random.Random(2)
    fps = list({rng.randrange(1 << 6) * 0x0101010101010101 & (1 << 63) - 1 ^ (1 << rng.randrange(62)) for _ in range(150)})
    got = dict(map(tuple, simhash_dedup.near_components(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, 32).collect()))
    links = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    assert got == union(links, {x for ab in links for x in ab})


def test_simhash_of_empty_table_and_clashing_columns(spark):
    assert simhash_dedup.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    df = spark.createDataFrame([(1, "a b c d", "x", 5, "y")], "doc_id long, text string, fp string, component long, key string")
    assert simhash_dedup.near_duplicates(df).first().component_id == 1
    assert simhash_dedup.keep_one(df).columns == df.columns


def line_sets(line, k=7):
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(4)
    lines = [" ".join(words(rng, rng.choice([3, 12, 50]))) for _ in range(60)]
    lines += [" ".join(edited(rng, rng.choice(lines).split(), 1)) for _ in range(60)]
    lines += ["ab", "abc", "Zwölf Boxkämpfer", "中文行中文行中文行中文行"]
    rows = [(i, "\n".join(rng.choice(lines + ["", " "]) for _ in range(rng.randint(1, 12))), "en") for i in range(40)]
    rows += [(100, None, None), (101, "", "en"), (102, "\n\n", "en"), (103, "  AB ", "x"), (5, rows[5][1], "en"), (6, "ab\nother text here", "en"), (None, rows[7][1], "en"), (104, ("long line here " * 9000).strip(), "en")]
    return rows


def test_lines_against_brute_force(spark, lined):
    out = line_dedup.dedup_lines(spark.createDataFrame(lined, KIND))
    assert out.columns == ["doc_id", "text", "lang", "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=repr)
    normal = lambda x: x.strip(" ").lower()
    big = 1 << 63
    kinds = sorted({normal(x) for _, t, _ in lined for x in (t or "").split("\n") if normal(x)})
    sets = {x: line_sets(x) for x in kinds}
    links = [(a, b) for a in kinds for b in kinds if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    classes = union(links, kinds)
    # the class keeps a line at the smallest doc_id; which of several lines of that document is free, so try it out
    first = {}
    for i, t, _ in lined:
        for x in (t or "").split("\n"):
            if normal(x):
                first[normal(x)] = min(first.get(normal(x), big), big if i is None else i)
    least = {}
    for x, c in classes.items():
        least[c] = min(least.get(c, big), first[x])
    kept_per_class = defaultdict(set)
    for (i, text, n, removed) in got:
        if text is None:
            assert (n, removed) == (0, 0)
            continue
        source = {t for j, t, _ in lined if j == i}
        lines = text.split("\n")
        assert any(n == t.count("\n") + 1 for t in source) and (removed == n - len(lines) or (text == "" and removed == n))
        for x in lines:
            if normal(x):
                kept_per_class[classes[normal(x)]].add((big if i is None else i, normal(x)))
    for c in set(classes.values()):
        assert len(kept_per_class[c]) == 1, c
        ((i, _),) = kept_per_class[c]
        assert i == least[c]


def test_lines_of_empty_table_and_clashing_columns(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], KIND)).count() == 0
    df = spark.createDataFrame([(1, "a\na", "x", 5, "y")], "doc_id long, text string, row string, removed long, key string")
    (row,) = line_dedup.dedup_lines(df).collect()
    assert row.text == "a" and row.n_removed == 1


@pytest.mark.parametrize("size, least", [(12, 0.93), (60, 0.97), (300, 0.97)])
def test_recall_of_line_bands(spark, size, least):
    """Pairs of lines whose shingle sets are just similar enough must share a band, short ones too."""
    rng = random.Random(size)
    letters = "abcdefghijklmnopqrstuvwxyz      "
    lines, pairs = [], []
    while len(pairs) < 300:
        a = "".join(rng.choice(letters) for _ in range(size))
        # ends differ, so the similarity is met closely
        m = len(line_sets(a))
        cut = max(1, round(0.1 * m))
        b = a[cut:] + "".join(rng.choice(letters) for _ in range(cut)) if rng.random() < 0.5 else a + "".join(rng.choice(letters) for _ in range(cut))
        s, t = line_sets(a), line_sets(b)
        if 0.8 <= len(s & t) / len(s | t) < 0.88:
            lines += [(2 * len(pairs), a), (2 * len(pairs) + 1, b)]
            pairs.append((a, b))
    keys = line_dedup.band_keys(spark.createDataFrame(lines, "id long, line string"), line_dedup.SHINGLE, line_dedup.VALUES, line_dedup.ROWS, line_dedup.PARTITIONS)
    got = defaultdict(set)
    for i, k in keys.collect():
        got[i].add(k)
    assert all(len(x) == 16 for x in got.values())
    found = sum(bool(got[2 * i] & got[2 * i + 1]) for i in range(300))
    assert found >= least * 300, found


def test_lines_of_the_same_shingles_have_the_same_bands(spark):
    rows = [(1, "ha" * 20), (2, "ha" * 300), (3, "x"), (4, "x")]
    got = defaultdict(set)
    for i, k in line_dedup.band_keys(spark.createDataFrame(rows, "id long, line string"), 7, 40, 5, 2).collect():
        got[i].add(k)
    assert got[1] == got[2] and got[3] == got[4] and not got[1] & got[3]


def test_sketches_spare_pairs_and_lose_no_similar_line(spark):
    rng = random.Random(9)
    lines = []
    for _ in range(60):
        base = words(rng, rng.randint(4, 60))
        lines += [" ".join(edited(rng, base, n)) for n in (0, 1, 3, 12)]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string").selectExpr("id", "encode(line, 'UTF-16BE') raw")
    sketch = line_dedup.sketches(df, 7)
    other = sketch.select(*[F.col(c).alias(c + "2") for c in sketch.columns])
    got = {tuple(r) for r in sketch.join(other, F.expr(f"id < id2 and {line_dedup.may_be_similar(0.8)}")).select("id", "id2").collect()}
    sets = [line_sets(x) for x in lines]
    every = [(a, b) for a in range(len(lines)) for b in range(a)]
    want = {(b, a) for a, b in every if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want and want <= got and len(got) < 0.1 * len(every)


@pytest.mark.parametrize("crowd", [0, 10, 1000])
def test_buckets_of_many_unlike_lines_are_compared_by_sketches(spark, crowd):
    """A passage common to all of a bucket's lines made a pair of nearly every two of them; by sketches and by tokens the components are the same."""
    rng = random.Random(10)
    passage = words(rng, 30)
    lines = [" ".join(words(rng, rng.randint(5, 9)) + passage) for _ in range(60)]
    lines += [x + " more" for x in lines[:20]]
    table = spark.createDataFrame(list(enumerate(lines)), "id long, line string").selectExpr("id", "encode(line, 'UTF-16BE') raw")
    sets = line_dedup.shingle_sets(table, 7).localCheckpoint()
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return line_dedup.similar(pairs, sets, 0.8)

    def tokens(ids):
        return ids.join(sets, "id").selectExpr("id", "c", "size(s) n", "posexplode(sort_array(s)) as (p, token)").selectExpr("id", "c", "token", "p + 1 as rank", "n").where("rank <= n - ceil(n * 0.8D - 1e-9) + 1")

    members = spark.createDataFrame([(i % 2, i) for i in range(80)] + [(2, i) for i in range(80)], "key long, id long")
    got = dict(map(tuple, link_buckets(members, verify, 0, tokens, 0.8, line_dedup.sketches(table, 7), line_dedup.may_be_similar(0.8), crowd).collect()))
    kinds = [line_sets(x) for x in lines]
    links = [(a, b) for a in range(80) for b in range(80) if a < b and len(kinds[a] & kinds[b]) >= 0.8 * len(kinds[a] | kinds[b])]
    assert got == union(links, {x for ab in links for x in ab})
    if crowd == 1000:
        assert asked[-1] < 0.25 * 80 * 79 / 2


def test_distinct_lines_are_counted_without_shuffling_their_texts(spark):
    rows = [(3, "Some line of text\n some line of TEXT \nx"), (2, "x\n\n  "), (None, "zz"), (None, None)]
    keyed = line_dedup.keyed_lines(spark.createDataFrame(rows, "doc_id long, text string"), 7, 40, 5, 2)
    assert sorted((r.first, r.n, len(set(r["keys"]))) for r in keyed.collect()) == [(2, 2, 16), (3, 2, 16), (line_dedup.LAST, 1, 16)]
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    sent = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert sent and all("h1#" in x and "line#" not in x and "raw#" not in x for x in sent)


def test_sets_made_in_runs_are_those_of_every_shingle(spark):
    lines = ["x" * n for n in (1, 6, 7)] + ["".join(chr(97 + i * i % 23) for i in range(n)) for n in (7, 8, 21, 22, 23, 38, 39, 200)]
    table = spark.createDataFrame(list(enumerate(lines)), "id long, line string").selectExpr("id", "encode(line, 'UTF-16BE') raw")
    made = line_dedup.shingle_sets(table, 7)
    got = {r.id: sorted(r.s) for r in made.collect()}
    one = line_dedup.spread(table, 7).selectExpr("id", "cast(shiftright(h, 32) as int) h").distinct().groupBy("id").agg(F.sort_array(F.collect_list("h")).alias("s"))
    assert got == {r.id: r.s for r in one.collect()}
    assert "flatten" in made._jdf.queryExecution().optimizedPlan().toString()


def test_sketches_are_one_column_and_settings_are_put_back(spark):
    """A column for each word made plans and driver memory grow; the settings of the run are put back."""
    table = spark.createDataFrame([(1, "some line"), (2, "")], "id long, line string").selectExpr("id", "encode(line, 'UTF-16BE') raw")
    rows = {r.id: r for r in line_dedup.sketches(table, 7).collect()}
    assert line_dedup.sketches(table, 7).columns == ["id", "size", "w"]
    assert [len(rows[i].w) for i in (1, 2)] == [line_dedup.WORDS] * 2 and rows[1].size == 3
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    line_dedup.dedup_lines(spark.createDataFrame([(1, "a\na", "x")], KIND)).collect()
    assert spark.conf.get(key) == before


def test_shared_keys_are_counted_in_one_map_and_the_setting_is_put_back(spark, monkeypatch):
    key, seen = "spark.sql.codegen.aggregate.map.twolevel.enabled", []
    write, before = line_dedup.stored, spark.conf.get(key)
    monkeypatch.setattr(line_dedup, "stored", lambda df, what: seen.append((what, spark.conf.get(key))) or write(df, what))
    members = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (3, 2), (None, 3), (-1, 3), (-1, 4), (-1, 5)], "key long, id long")
    assert sorted(r.key for r in line_dedup.shared_keys(members).collect()) == [-1, 1]
    assert seen == [("keys", "false")] and spark.conf.get(key) == before


def parts_of(text):
    """(line, start, length, words) of paragraphs: sentences and lines of six words or more, numbered within the document."""
    out, at = [], 0
    for pos, line in enumerate((text or "").split("\n")):
        lo = 0
        while lo <= len(line):
            m = re.compile(r"[.!?](?= |$)").search(line, lo)
            hi = m.end() if m else len(line)
            ws = [w for w in (re.sub(r"[\W_]+", "", x) for x in line[lo:hi].lower().split(" ")) if w]
            if len(ws) >= 6:
                out.append((pos, at + lo, hi - lo, tuple(ws)))
            lo = hi + 1
            if not m:
                break
        at += len(line) + 1
    return out


def sentence(rng, n):
    return " ".join(words(rng, n)).capitalize() + rng.choice(".!?")


def test_passages_against_brute_force(spark):
    rng = random.Random(8)
    passages = [" ".join(sentence(rng, rng.randint(7, 30)) for _ in range(5)) for _ in range(6)]
    passages += [" ".join([*p.split(" ")[:-12], "edited", *p.split(" ")[-11:]]) for p in passages[:3]]
    docs = []
    for i in range(25):
        ws = " ".join(sentence(rng, rng.randint(3, 20)) for _ in range(6)).split(" ")
        at = rng.randrange(len(ws))
        ws[at:at] = rng.choice(passages).split(" ")
        docs.append((i, " ".join(ws) + "\nshort line here.\n" + sentence(rng, 12), "en"))
    hot = "one line of boilerplate that many have here now."
    docs += [(50 + i, sentence(rng, 9) + "\n" + hot, "en") for i in range(4)]
    docs += [(60, None, "en"), (61, "", "en"), (3, docs[3][1], "en"), (None, docs[4][1], "en"), (62, " ".join(words(rng, 20000)), "en"), (63, "no  double blanks. or _ or ... or x.", "en")]
    df = spark.createDataFrame(docs, KIND)
    got = substring_dedup.repeated_paragraphs(df).collect()
    spots = []
    for i, t in sorted({(d[0], d[1]) for d in docs}, key=repr):
        spots += [(i, no, *p) for no, p in enumerate(parts_of(t))]
    kinds = sorted({s[-1] for s in spots})
    sets = {k: {k[j : j + 5] for j in range(len(k) - 4)} for k in kinds}
    links = [(a, b) for a in kinds for b in kinds if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    classes = union(links, kinds)
    size = Counter(classes[s[-1]] for s in spots)
    repeated = [s for s in spots if size[classes[s[-1]]] > 1]
    runs, place = Counter(), {}
    for s in sorted(repeated, key=lambda s: (repr(s[0]), s[1])):
        place[s[0], s[1]] = run = place.get((s[0], s[1] - 1), (s[0], s[1]))
        runs[run] += len(s[-1])
        runs[run, s[2]] += len(s[-1])
    long = [s for s in repeated if runs[place[s[0], s[1]], s[2]] >= 20 or runs[place[s[0], s[1]]] >= 50]
    size = Counter(classes[s[-1]] for s in long)
    want = {(s[0], s[3], s[4]): classes[s[-1]] for s in long if size[classes[s[-1]]] > 1}
    mine = {(r.doc_id, r.start, r.n_chars): r.component for r in got}
    assert len(got) == len(mine) and set(mine) == set(want)
    assert len({(mine[x], want[x]) for x in want}) == len(set(mine.values())) == len(set(want.values()))
    assert not [r for r in got if r.doc_id is not None and 50 <= r.doc_id < 60]
    assert Counter(r.component for r in got if r.keep) == {c: 1 for c in set(mine.values())}
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()}
    for r in got:
        text = next(t for i, t, _ in docs if i == r.doc_id)
        assert (text[r.start : r.start + r.n_chars] in left[r.doc_id]) == r.keep or r.doc_id == 3
    assert left[60] is None and left[61] == "" and left[62] == docs[-2][1]
    assert substring_dedup.repeated_paragraphs(spark.createDataFrame([], KIND)).count() == 0


def test_passages_over_several_lines(spark):
    rng = random.Random(12)
    passage = [" ".join(words(rng, 12)) for _ in range(5)]
    short = [" ".join(words(rng, 12)) for _ in range(2)]
    other = lambda: " ".join(words(rng, 14))
    docs = [(i, "\n".join([other(), *passage, other()]), "en") for i in range(3)] + [(10 + i, "\n".join([other(), *short, other()]), "en") for i in range(3)]
    got = Counter(r.doc_id for r in substring_dedup.repeated_paragraphs(spark.createDataFrame(docs, KIND)).collect())
    assert got == {0: 5, 1: 5, 2: 5}


def test_texts_stay_in_place_for_few_candidates(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    same = words(30)
    docs = spark.createDataFrame([(i, f"{words(12)}.\n{same if i % 2 else same.rsplit(' ', 1)[0]}.", "en") for i in range(8)], KIND)
    plans, stored = {}, substring_dedup.stored
    monkeypatch.setattr(substring_dedup, "stored", lambda df, what: plans.setdefault(what, df._jdf.queryExecution().sparkPlan().toString()) and stored(df, what))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = substring_dedup.repeated_paragraphs(docs).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 8 and len({r.component for r in got}) == 1 and [r.doc_id for r in got if r.keep] == [0]
    assert all("BroadcastHashJoin" in plans[x] and "SortMergeJoin" not in plans[x] for x in ("ids", "payload"))


def test_bands_of_passages_have_high_recall():
    recall = lambda s: 1 - (1 - s**substring_dedup.ROWS) ** substring_dedup.BANDS
    assert recall(substring_dedup.THRESHOLD) >= 0.999
    rng = random.Random(12)
    missed = 0
    for _ in range(600):
        ws = [f"w{rng.randrange(10**9)}" for _ in range(59)]
        # 55 shingles, one word changed 5 from the end: 50 of 60 are shared
        lines = [" ".join(ws), " ".join([*ws[:-5], "changed", *ws[-4:]])]
        got = substring_dedup.cut_lines(lines, 5, substring_dedup.BANDS, substring_dedup.ROWS, 6)
        missed += not any(got[f"k{b}"][0] == got[f"k{b}"][1] for b in range(substring_dedup.BANDS))
    assert missed <= 2


def grams(ws):
    k = min(5, len(ws))
    return [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]


def similarity(a, b):
    kinds = set(a) | set(b)
    low = sum(min(a.count(x), b.count(x)) for x in kinds)
    return low / (len(a) + len(b) - low)


def test_leaks_against_brute_force(spark):
    rng = random.Random(21)
    items = [words(rng, n) for n in (12, 15, 30, 50, 57, 57)] + [["one", "two", "three"], ["again"] * 14]
    docs = []
    for i in range(40):
        ws = words(rng, rng.choice([30, 300]))
        if i % 2:
            it = rng.choice(items)
            at = rng.randrange(len(ws))
            ws[at:at] = edited(rng, it, rng.choice([0, 0, 1, 2])) if len(it) > 20 else it
        docs.append((i, ", ".join(w.capitalize() if rng.random() < 0.2 else w for w in ws), "en"))
    docs += [(60, None, "en"), (61, "", "en"), (62, " ".join(items[4][:-2]), "en"), (1, docs[1][1], "en"), (63, " ".join(words(rng, 20000) + items[5]), "en"), (64, " ".join(items[0] * 3), "en")]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "..")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(spark.createDataFrame(docs, KIND), table).collect()}
    want = {}
    for i, t, _ in docs:
        ws = re.findall(r"[^\W_]+", (t or "").lower())
        for k, item in enumerate(items):
            if len(ws) > 5000 and k != 5:
                continue
            n = min(len(item), len(ws))
            if not n:
                continue
            size = min(5, len(item))
            if n < size:
                continue
            best = max(similarity(grams(ws[s : s + n]), grams(item)) if n >= 5 else float(ws[s : s + n] == item) for s in range(len(ws) - n + 1))
            if best >= 0.8:
                want[i, k] = best
    assert set(got) == set(want)
    assert all(abs(got[x] - want[x]) < 1e-5 for x in want)
    clean = decontaminate.decontaminate(spark.createDataFrame(docs, KIND), table)
    assert clean.columns == ["doc_id", "text", "lang"]
    assert {r.doc_id for r in clean.collect()} == {i for i, _, _ in docs} - {i for i, _ in want}


def test_leaks_of_moved_inserted_and_deleted_blocks(spark):
    rng = random.Random(22)
    item = [f"w{i}" for i in range(60)]
    a, b = item[:30], item[30:]
    around = lambda: [f"x{rng.randrange(10**6)}" for _ in range(80)]
    docs = [b + a, item[:20] + ["new"] * 4 + item[20:], item[:25] + item[30:], b + ["x"] * 40 + a]
    docs = [(i, " ".join(around() + d + around()), "en") for i, d in enumerate(docs)]
    got = {r.doc_id: r.similarity for r in decontaminate.leaks(spark.createDataFrame(docs, KIND), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    want = {}
    for i, t, _ in docs:
        ws = t.split(" ")
        best = max(similarity(grams(ws[s : s + 60]), grams(item)) for s in range(len(ws) - 59))
        if best >= 0.8:
            want[i] = best
    assert 0 in want and set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f g", "x")], KIND), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 1


def test_shared_folder_follows_the_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert spark.range(1).select(F.lit(1)).count() == 1
