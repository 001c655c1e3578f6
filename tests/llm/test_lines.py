import random

from labelweave.llm import lines
from labelweave.llm.lines import LEAST_WORDS, dedup_lines, increasing, op5_line_dedup, patience


def plain(docs, least=LEAST_WORDS):
    """{doc_id: text} by the definition: every pair of documents, every run of lines that both hold; nothing of the operator's own is used."""
    rows = {i: [(at, line.strip(), len(line.split())) for at, line in enumerate((t or "").split("\n")) if line.strip()] for i, t in docs.items()}
    out, held = {}, {i: {x[1] for x in own} for i, own in rows.items()}
    for i in sorted(docs):
        gone, own = set(), rows[i]
        for j in sorted(docs):
            if j >= i:
                break
            if held[i].isdisjoint(held[j]):
                continue
            places = {}
            for q, x in enumerate(rows[j]):
                places.setdefault(x[1], []).append(q)
            for p in range(len(own)):
                for q in places.get(own[p][1], ()):
                    if p and q and own[p - 1][1] == rows[j][q - 1][1]:
                        continue  # not the start of a common run
                    n = 0
                    while p + n < len(own) and q + n < len(rows[j]) and own[p + n][1] == rows[j][q + n][1]:
                        n += 1
                    if sum(x[2] for x in own[p : p + n]) >= least:
                        gone |= {x[0] for x in own[p : p + n]}
        out[i] = None if docs[i] is None else "\n".join(x for at, x in enumerate(docs[i].split("\n")) if at not in gone)
    return out


def longest(values):
    """Length of a longest increasing run, by dynamic programming."""
    best = []
    for k, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(k) if values[j] < v), default=0))
    return max(best, default=0)


def test_increasing():
    rng = random.Random(5)
    for _ in range(200):
        v = rng.sample(range(50), rng.randint(0, 20))
        found = [v[k] for k in increasing(v)]
        assert found == sorted(found) and len(found) == longest(v)


def test_patience():
    assert patience([1, 9, 2], [1, 3, 1, 9, 9, 2]) == [(0, 0), (1, 4), (2, 5)]
    assert patience([5, 6, 7], [6, 7, 5]) == [(1, 0), (2, 1)]
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(9) for _ in range(rng.randint(0, 14))] for _ in "ab")
        found = patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x < y for pair in zip(found, found[1:]) for x, y in zip(*pair))


def test_query(spark, small):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = op5_line_dedup(spark, small).collect()
    want = plain(docs)
    assert {x.doc_id: x.text for x in found} == want and len(found) == len(docs)
    assert any(x.n_removed for x in found)
    assert all(x.n_lines - x.n_removed == len([*filter(None, [x.text])] and x.text.split("\n")) for x in found if x.n_removed < x.n_lines)


def test_random_texts_against_the_definition(spark):
    rng = random.Random(2)
    pool = [f"line number {k} " + "word " * rng.randint(0, 6) for k in range(25)] + ["", "  ", "short"]
    docs = {i: "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for i in range(120)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(5)
    for least in (1, 5, 20):
        assert {x.doc_id: x.text for x in dedup_lines(df, least_words=least).collect()} == plain(docs, least)


def test_copies_whose_lines_others_held_first(spark):
    """Lines of a copy that stand in different earlier documents, alone too short to go."""
    lines = ["one two three", "four five six", "seven eight nine"]
    docs = {1: lines[0] + "\nquite another text of six words", 2: lines[1] + "\nelsewhere", 3: "a b\n" + lines[2], 4: "\n".join(lines), 5: "\n".join(lines), 6: "\n".join(reversed(lines))}
    docs |= {7: "hdr\nfoo bar baz\nhdr\nbody text that is long enough here", 8: "hdr\nbody text that is long enough here", 9: "a line of five words\nanother line of five words", 10: "another line of five words\na line of five words"}
    found = {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()}
    assert found == {**docs, 5: "", 8: "", 10: ""} == plain(docs)


def test_edge_cases(spark):
    a = "one two three four five six\nseven eight nine ten eleven"
    long = "\n".join(f"a line with the number {k}" for k in range(20_000))
    rows = [(1, a), (2, None), (3, ""), (None, a), (4, a), (4, a), (4, "new text of six words here\n" + a), (1, a), (5, "   " + a.replace("\n", " \n\n")), (6, long), (7, long + "\ntail"), (8, "five\nsix")]
    docs = spark.createDataFrame([(*r, 1, "v") for r in rows], "doc_id bigint, text string, gone int, _doc string")
    found = dedup_lines(docs)
    assert found.columns == docs.columns
    texts = sorted(((x.doc_id or 0, x.text) for x in found.collect()), key=str)
    assert texts == sorted([(1, a), (1, a), (2, None), (3, ""), (0, a), (4, ""), (4, ""), (4, "new text of six words here"), (5, ""), (6, long), (7, "tail"), (8, "five\nsix")], key=str)
    assert sorted(x.doc_id or 0 for x in dedup_lines(docs, drop_emptied=True).collect()) == [0, 1, 1, 2, 3, 4, 6, 7, 8]
    assert dedup_lines(docs.limit(0)).count() == 0


def shared_lines(a, b):
    """What `blocks` takes, of two documents as lists of (line, words)."""
    both = {x for x, _ in a} & {x for x, _ in b}
    words = dict(a)
    at = lambda d, x: [n for n, y in enumerate(d) if y[0] == x]
    return [{"at": at(a, x), "there": at(b, x), "lines": at(a, x), "words": words[x]} for x in sorted(both)]


def test_alignment_decides(monkeypatch):
    """All pairs of random documents against the definition; without the alignment nothing goes."""
    rng = random.Random(9)
    size = {x: 1 + x % 4 for x in range(12)}
    cases = []
    for _ in range(3000):
        a, b = ([(x, size[x]) for x in (rng.randrange(12) for _ in range(rng.randint(0, 16)))] for _ in "ab")
        text = lambda d: "\n".join(" ".join([f"w{x}"] * n) for x, n in d)
        gone = lines.blocks(shared_lines(a, b), 5)
        want = plain({1: text(b), 2: text(a)})[2]
        assert "\n".join(line for k, line in enumerate(text(a).split("\n")) if k not in gone) == want
        cases.append((a, b, gone))
    assert sum(bool(c[2]) for c in cases) > 300
    monkeypatch.setattr(lines, "patience", lambda a, b: [])
    assert not any(lines.blocks(shared_lines(a, b), 5) for a, b, _ in cases)


def test_long_documents_in_another_order():
    """Ten thousand blocks, of which none keeps its place, take no more than a pass each."""
    n = 10_000
    a, b = [(x, 5) for x in range(n)], [(x, 5) for x in reversed(range(n))]
    assert lines.blocks(shared_lines_of_distinct(a, b), 5) == list(range(n))


def shared_lines_of_distinct(a, b):
    place = {x: n for n, (x, _) in enumerate(b)}
    return [{"at": [n], "there": [place[x]], "lines": [n], "words": w} for n, (x, w) in enumerate(a)]


def test_rare_and_common_lines_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    pool = [f"line number {k} with enough words" for k in range(40)] + [f"short {k}" for k in range(10)]
    docs = {i: "\n".join(rng.choice(pool[: 5 + i % 45]) for _ in range(rng.randint(0, 12))) for i in range(80)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    for rare in (1, 3, 1000):
        monkeypatch.setattr(lines, "RARE", rare)
        assert {x.doc_id: x.text for x in dedup_lines(df).collect()} == plain(docs)
