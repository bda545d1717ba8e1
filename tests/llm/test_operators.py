"""The operators against plain versions on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from starloom.llm import decontaminate, edit_distance, license_scan, line_dedup, packing, quality_gam, quality_rules, sharding, simhash
from starloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven wise owls watch from an old oak tree beside some quiet river bend in late summer light".split()


def prose(rng, n):
    words = [rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "er", "ing"]) for _ in range(n)]
    lines, at = [], 0
    while at < n:
        k = rng.randint(8, 20)
        lines.append(" ".join(words[at : at + k]).capitalize() + ".")
        at += k
    return "\n".join(lines)


def rows_of(*texts):
    return [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(30)]
    near = [b.replace("fox", "cat", 1) for b in base[:6]]
    long = prose(rng, 30_000)
    return [*base, *near, base[0], base[0], None, "", " \n\t", "one", "two words", long, long + " more", base[1].upper()]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([*rows_of(*texts), (None, texts[3], None, None, None), (7, texts[7], "en", "src0", None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def groups_by_pairs(items, near):
    """The smallest member that each item's links reach, by trying all pairs."""
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(items)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)] + [(4, 4), (None, 3)]
    linked = {frozenset(x) for x in links if None not in x}
    found = connected_components(spark.createDataFrame(links, "a long, b long"))
    nodes = {x for pair in linked if len(pair) > 1 for x in pair}
    adjacent = defaultdict(set)
    for pair in linked:
        for x in pair:
            adjacent[x] |= pair
    expected = {}
    for n in sorted(nodes):
        if n not in expected:
            reach, stack = set(), [n]
            while stack:
                x = stack.pop()
                if x not in reach:
                    reach.add(x)
                    stack += adjacent[x]
            expected |= dict.fromkeys(reach, n)
    assert sorted(map(tuple, found.collect())) == sorted(expected.items())
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(spark, docs, empty, tmp_path):
    out = sharding.two_pass_shuffle(docs.withColumnsRenamed({"lang": "shard"}), shards=7, bucket_bytes=20_000)
    rows = out.collect()
    assert len({r.bucket for r in rows}) > 5 and Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 16
    assert set(by) == set(range(7)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.two_pass_shuffle(docs.repartition(3), shards=7, bucket_bytes=20_000).collect()
    assert sorted((str(r.doc_id), r.shard, r.slot) for r in rows if r.doc_id != 7) == sorted((str(r.doc_id), r.shard, r.slot) for r in again if r.doc_id != 7)
    sharding.write_shards(out.select("doc_id", "text", "shard", "slot"), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    assert sharding.two_pass_shuffle(empty).count() == 0
    hot = spark.range(300).selectExpr("1L AS doc_id", "'same' AS text", "id AS place")
    spread = sharding.two_pass_shuffle(hot, shards=4, bucket_bytes=1000, salt=hot.place).collect()
    assert max(Counter(r.bucket for r in spread).values()) < 150 and Counter(r.shard for r in spread) == dict.fromkeys(range(4), 75)


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(3)
    counts = Counter(tuple(sharding.fisher_yates(3, rng)) for _ in range(6000))
    assert len(counts) == 6 and max(counts.values()) < 1200 and min(counts.values()) > 800
    assert len(sharding.fisher_yates(0, rng)) == 0 and len(sharding.fisher_yates(1, rng)) == 1


def plain_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, empty):
    rows = docs.collect()
    prints = {r.text: plain_fingerprint(r.text) for r in rows}
    assert prints[None] == prints[""] == prints[" \n\t"] == 0
    reach = groups_by_pairs(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[reach[prints[r.text]]] = min(least.get(reach[prints[r.text]], r.doc_id), r.doc_id)
    found = simhash.simhash_groups(docs.withColumnRenamed("lang", "fingerprint")).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == Counter((r.doc_id, f"{prints[r.text]:016x}", least[reach[prints[r.text]]]) for r in rows)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.simhash_groups(empty).count() == 0 and simhash.keep_one_of_each(empty).count() == 0


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_near_links_find_every_pair(spark, segments):
    rng = random.Random(segments)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(4):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    found = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, segments).collect()
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert sorted(map(tuple, found)) == sorted(expected)
    reach = groups_by_pairs(signed, lambda a, b: (a, b) in expected)
    found = simhash.linked_components(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, segments).collect()
    assert sorted(map(tuple, found)) == sorted((n, c) for n, c in reach.items() if sum(v == c for v in reach.values()) > 1)


def test_gam(spark, texts):
    rng = random.Random(2)
    good = [prose(rng, 120) for _ in range(150)]
    bad = [" | ".join(rng.choice(WORDS) for _ in range(80)) if i % 2 else prose(rng, 60).upper().replace(" ", "!! ") for i in range(150)]
    all_texts = [t for pair in zip(good, bad) for t in pair] + [None, "", "word"]
    frame = spark.createDataFrame(rows_of(*all_texts), SCHEMA).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(i, (i + 1) % 2, 0) for i in range(300)] + [(0, None, 0), (1, 7, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality_gam.quality_scores(frame, labels).collect()}
    assert len(found) == 303 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    held = [r for r in found.values() if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == (r.doc_id + 1) % 2 for r in held) > 0.95 * len(held)
    unlabelled = quality_gam.quality_scores(frame, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in unlabelled} == {0.5}
    assert quality_gam.quality_scores(frame.limit(0), labels).count() == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(quality_gam.FEATURES)))
    x[:, :2] = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_packing(spark, docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    extra = spark.createDataFrame(rows_of("<|endoftext|> I'll pay 12€ naïve étude ΣΟΦΟΣ    x <|startoftext|>y", "'s|'re a's 're5 ’s ﬁ Ⅷ ǅ İ"), SCHEMA)
    frame = docs.unionByName(extra).withColumnRenamed("lang", "offset")
    found = packing.pack_documents(frame.select("doc_id", "text", "offset"), keep_ids=True, block_items=16).collect()
    expected = Counter()
    for r in frame.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for i, b in enumerate(range(0, len(ids), 4096)):
            raw = np.array(ids[b : b + 4096], "<u4").tobytes()
            expected[r.doc_id, i, b, len(raw) // 4, crc32(raw), raw] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in found) == expected
    check_sequences(found, 4096)
    assert packing.pack_documents(empty).count() == 0


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_genetic_packing_is_as_good_as_best_fit(spark):
    rng = np.random.default_rng(4)
    for kind in range(3):
        lengths = np.sort([rng.integers(1, 100, 120), rng.integers(26, 51, 120), np.repeat([51, 27, 26, 23, 25], 24)][kind])[::-1].astype(np.int64)
        plain = packing.fitness(lengths, packing.pack(lengths, range(len(lengths)), 100), 100)
        best = packing.evolve(lengths, [], 100, 6, 20, np.random.default_rng(1))[0]
        assert np.bincount(best, weights=lengths).max() <= 100 and packing.fitness(lengths, best, 100) <= plain
        for _ in range(30):
            child = packing.crossover(lengths, best, packing.pack(lengths, rng.permutation(len(lengths)).tolist(), 100), 100, rng)
            assert len(child) == len(lengths) and child.min() >= 0 and np.bincount(child, weights=lengths).max() <= 100
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 101, 900))], "doc_id long, length long")
    rows = packing.pack_pieces(pieces, capacity=100, block_items=200, epochs=3).collect()
    assert len(rows) == 900 and check_sequences(rows, 100) <= 1.06 * sum(r.length for r in rows) / 100


def test_genetic_packing_beats_best_fit():
    """Threes of items that fill a bin exactly: 40 bins suffice, best-fit decreasing takes 45 or more."""
    for seed in range(3):
        rng, lengths = np.random.default_rng(seed), []
        for _ in range(40):
            a = int(rng.integers(26, 49))
            b = int(rng.integers(26, 75 - a))
            lengths += [a, b, 100 - a - b]
        lengths = np.sort(np.array(lengths))[::-1].astype(np.int64)
        plain = packing.fitness(lengths, packing.pack(lengths, range(len(lengths)), 100), 100)[0]
        best = packing.evolve(lengths, [], 100, 6, 40, np.random.default_rng(1))[0]
        assert np.bincount(best, weights=lengths).max() <= 100 and 40 <= packing.fitness(lengths, best, 100)[0] < plain


def test_quality_rules_against_sql(spark, docs, empty):
    rows = [r for r in docs.collect() if r.doc_id not in (None, 7)]
    rng = random.Random(8)
    page = prose(rng, 150)
    more = [page + "\nHome | About | Contact | Login", page + "\nAll rights reserved.", "x" * 50 + "\n" + "a b c d " * 40, page.replace("\n", "\n\n\n"), " ".join(page.split()[:40]) + " ### ### ### $$$ *** &&&", page + "\n" + page, "Sign in\n" + page + "\nThe\nnext page\x85x"]
    more.append(page + "\nCopyright 2020 by us\nmenué of the day\nſubscribe to our letter\nAlle Rechte vorbehalten\nPolítica de privacidad")
    more.append("She said that a cookie and the copyright of an old song were all that her aunt had ever left her. " + page.replace("\n", " "))
    frame = spark.createDataFrame([tuple(r) for r in rows] + [(900 + i, t, "en", "s", 1) for i, t in enumerate(more)], SCHEMA).withColumnRenamed("lang", "kept")
    found = quality_rules.assess_documents(frame)
    documents = pa.table({"doc_id": pa.array([r[0] for r in frame.collect()]), "text": pa.array([r[1] for r in frame.collect()], pa.string())})
    con = duckdb.connect()
    con.register("documents", documents)
    columns = ["doc_id", *quality_rules.METRICS, "lost_chars", "base_failed", "kept"]
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({quality_rules.OP7_SQL}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in found.select(columns).orderBy("doc_id").collect()] == expected
    cleaned = {r.doc_id: r for r in quality_rules.clean_documents(docs.unionByName(frame.withColumnRenamed("kept", "lang"))).collect()}
    assert "Login" not in cleaned[900].text and "reserved" not in cleaned[901].text and cleaned[900].n_chars == len(cleaned[900].text) and 902 not in cleaned
    assert cleaned[908].text == more[8] and cleaned[907].text.endswith(".\nſubscribe to our letter")  # a long clean paragraph that mentions a cookie stays
    assert quality_rules.assess_documents(empty).count() == 0 and quality_rules.clean_documents(empty).count() == 0


def test_line_dedup(spark, docs, empty):
    rows = [r for r in docs.collect() if r.doc_id not in (None, 7)]
    rng = random.Random(3)
    line = "This notice about the quiet river and the seven wise owls stands under every single story of our summer collection, year after year."
    variants = [line.replace(w, w + "z", 1) for w in line.split()[:12]] + [line, line.upper(), line + "!"]
    own = [tuple(r) for r in rows if len(r.text or "") < 5000] + [(500 + i, prose(rng, 40) + "\n" + v, "en", "s", 1) for i, v in enumerate(variants)]
    frame = spark.createDataFrame(own, SCHEMA).withColumnRenamed("lang", "line")
    places = defaultdict(list)
    for doc_id, text, *_ in own:
        for i, form in line_dedup.forms(text):
            places[form].append((doc_id, i))
    names = list(places)
    prints = dict(zip(names, line_dedup.simhashes(names).view(np.uint64).tolist()))

    def near(a, b):
        most = int(0.2 * max(len(a), len(b)) + 1e-9)
        return (prints[a] ^ prints[b]).bit_count() <= 3 and edit_distance.distance(a, b, most) <= most

    group = groups_by_pairs(names, near)
    keeper = {}
    for form, where in places.items():
        keeper[group[form]] = min(keeper.get(group[form], (10**9, 0)), *where)
    expected = {(d, i): keeper[group[f]] == (d, i) for f, where in places.items() for d, i in where}
    found = line_dedup.judge_lines(frame).collect()
    assert {(r.doc_id, r.line): r.kept for r in found} == expected and len(found) == len(expected)
    assert len(set(group.values())) < len(names)  # there were near lines
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame.withColumnRenamed("line", "lang")).collect()}
    for doc_id, text, *_ in own:
        gone = {i for (d, i), kept in expected.items() if d == doc_id and not kept}
        left = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        assert out.get(doc_id) == (left if not gone or left.strip() else None)
    assert line_dedup.judge_lines(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0
    repeated = line_dedup.judge_lines(docs.where("doc_id = 7 OR doc_id IS NULL")).collect()
    assert sum(r.kept for r in repeated) == len({r.group for r in repeated})


def plain_distance(a, b, free=False):
    row = [0 if free else j for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        following = [i + 1]
        for j, y in enumerate(b):
            following.append(min(row[j] + (x != y), row[j + 1] + 1, following[j] + 1))
        row = following
    return min(row) if free else row[-1]


def test_edit_distance_and_pigeonhole_search():
    rng = random.Random(6)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(150):
        a, b = draw("abc", rng.randint(0, 80)), draw("abc", rng.randint(0, 80))
        exact, most = plain_distance(a, b), rng.randint(0, 40)
        assert edit_distance.distance(a, b) == exact and edit_distance.distance(a, b, most) == min(exact, most + 1)
    for _ in range(150):
        item = decontaminate.normalise(draw("ab c", rng.randint(5, 60)))
        if not item:
            continue
        edited = "".join(rng.choice([c] * 12 + ["", c + "b", "a"]) for c in item)
        text = decontaminate.normalise(draw("abc ", 40) + edited + draw("abc ", 40))
        found = decontaminate.Index([(1, item)], 0.15).find(text)
        exact, most = plain_distance(item, text, free=True), int(0.15 * len(item))
        assert (0 in found) == (exact <= most)
        if found:
            d, start, stop = found[0]
            assert d == exact == plain_distance(item, text[start:stop])


def test_decontamination(spark, docs, empty):
    items = ["Nine silver foxes crossed the frozen lake before dawn, and nobody in the village heard them go.", "What is the boiling point of water at sea level, and how does it change with height?", "", None, "Nine silver foxes crossed the frozen lake before dawn, and nobody in the village heard them go."]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rng = random.Random(9)
    leaks = [items[0], prose(rng, 50) + "\n" + items[0].upper() + "\n" + prose(rng, 50), prose(rng, 9000) + " " + items[1].replace("boiling", "boilng").replace("height", "heigt"), prose(rng, 80) + items[1][: len(items[1]) // 2]]
    frame = docs.unionByName(spark.createDataFrame([(800 + i, t, "en", "s", 1) for i, t in enumerate(leaks)], SCHEMA)).withColumnRenamed("lang", "distance")
    for block_bytes in (1 << 20, 120):
        found = decontaminate.benchmark_hits(frame, bench, block_bytes=block_bytes).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in found) == [(800, 0, 0), (800, 4, 0), (801, 0, 0), (801, 4, 0), (802, 1, 2)]
        kept = decontaminate.decontaminate(frame, bench, block_bytes=block_bytes)
        assert kept.columns == frame.columns and kept.count() == frame.count() - 3
    assert decontaminate.benchmark_hits(empty, bench).count() == 0 and decontaminate.benchmark_hits(frame, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(frame, bench.limit(0)).count() == frame.count()


def test_license_scan(spark, docs, empty, texts, monkeypatch):
    rng = random.Random(4)
    apache = license_scan.TEMPLATES["Apache-2.0 warranty"]
    planted = [prose(rng, 300) + "\nReleased under the MIT License.\n" + prose(rng, 40), prose(rng, 5000) + " " + apache.replace("AS IS", "as it is") + " " + prose(rng, 100), "All rights\n reserved", "Licensed under CC BY-SA 4.0"]
    monkeypatch.setattr(license_scan, "SPAN", 256)
    scanner = license_scan.Scanner(license_scan.TEMPLATES)

    def plain(text):
        words, best = license_scan.words_of(text), {}
        for k, classes in scanner.classes.items():
            n = len(words) - k + 1
            for c, templates in classes.items() if n > 0 else ():
                for at in range(0, n, max(1, c // 2)):
                    window = license_scan.shingles(words[at : at + max(4, 2 * c) + k - 1], k)
                    for name, own, _ in templates:
                        share = len(own & window) / len(own)
                        if share >= 0.8 and share > best.get(name, (0.0, 0))[0]:
                            best[name] = share, at
        return [(n, at, s) for n, (s, at) in sorted(best.items())]

    whole = license_scan.TEMPLATES["BSD-3-Clause text"].split()
    edited = [" ".join(w for i, w in enumerate(whole) if i % 60), prose(rng, 700) + "\n" + " ".join(whole) + "\n" + prose(rng, 300), " ".join(w for i, w in enumerate(whole) if i % 9)]
    for t in [*planted, *edited, *texts]:
        assert scanner.find(t) == plain(t)
    names = [{n for n, _, _ in scanner.find(t)} for t in edited]
    assert "BSD-3-Clause text" in names[0] and "BSD-3-Clause text" in names[1] and "BSD-3-Clause text" not in names[2]  # the last keeps too few shingles
    frame = docs.unionByName(spark.createDataFrame([(800 + i, t, "en", "s", 1) for i, t in enumerate(planted)], SCHEMA)).withColumnRenamed("lang", "template")
    found = license_scan.scan_documents(frame)
    assert sorted((r.doc_id, r.template) for r in found.collect()) == [(800, "MIT"), (801, "Apache-2.0 warranty"), (802, "All rights reserved"), (803, "CC-BY-SA-4.0")]
    assert set(frame.columns) <= set(found.columns) and license_scan.scan_documents(empty).count() == 0 and license_scan.scan_documents(frame, templates={}).count() == 0
