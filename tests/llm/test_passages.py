import random
import re

from tessera.llm import passages as P

from .helpers import EDGE, SF, lower_az, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(t, n):
    w = WORD.findall(lower_az(t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_planted_passages(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(51) for _ in range(12)]
    near = shared[0].split()
    near[0] = "other"
    rows = [(100 + i, prose(rnd.randrange(30, 200))) for i in range(60)]
    planted = {}
    for k, s in enumerate(shared):
        for j in range(rnd.randrange(2, 5)):
            i = 200 + 10 * k + j
            planted[i] = s
            rows.append((i, f"{prose(rnd.randrange(0, 40))} {s.upper() if j % 2 else s}{rnd.choice([' ', '.', chr(10)])} {prose(rnd.randrange(0, 40))} é ☃"))
    rows += [(900, " ".join(near)), (901, "short boilerplate line of nine words here and there"), (902, "short boilerplate line of nine words here and there")]
    rows += EDGE
    docs = table(spark, rows)
    got = P.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {*planted, 900}
    by = dict(rows)
    for r in got:
        assert r.kept_in <= r.doc_id and r.removed == (r.doc_id != r.kept_in)
        cut = by[r.doc_id][r.start : r.end]
        assert len(WORD.findall(lower_az(cut))) >= P.LENGTH and windows(cut, 20) & windows(by[r.kept_in], 20)
    left = {r.doc_id: r for r in P.remove_passages(docs, length="n_chars").collect()}
    assert P.remove_passages(docs).columns == docs.columns and len(left) >= len({d for d, _ in rows}) - 1
    for s in shared:
        assert sum(tuple(WORD.findall(s)) in windows(left[i].text, 51) for i in planted if i in left and planted[i] == s) == 1
    assert all(left[i].text == t for i, t in rows if i not in planted and i != 900)
    assert left[201].n_chars == len(left[201].text)


def test_wholly_repeated_documents_go_and_empty_tables_stay_empty(spark):
    t = " ".join(f"w{i * 37 % 1009}" for i in range(28))
    assert P.repeated_passages(table(spark, [])).count() == 0 == P.remove_passages(table(spark, [])).count()
    assert [r.doc_id for r in P.remove_passages(table(spark, [(1, t), (2, t), (2, t)])).collect()] == [1]


def test_query_catches_every_long_repeat(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, where = 51, {}
    for d, t in docs:
        for w in windows(t, n):
            where.setdefault(w, set()).add(d)
    want = {d for v in where.values() if len(v) > 1 for d in v}
    short = {}
    for d, t in docs:
        for w in windows(t, 20):
            short.setdefault(w, set()).add(d)
    allowed = {d for v in short.values() if len(v) > 1 for d in v}
    got = {r.doc_id for r in P.query(spark, SF).collect()}
    assert want and want <= got <= allowed


def test_near_copies_of_natural_paragraphs(spark):
    rnd = random.Random(8)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(3, 9))) for _ in range(n))
    rows, first = [], {}
    for k, (n, places) in enumerate([(60, [30]), (50, [25]), (80, [27, 54]), (60, [20]), (39, [19])] * 6):
        a = prose(n).split()
        b = [f"changed{k}x{i}" if i in places else x for i, x in enumerate(a)]
        as_block = k % 2
        wrap = lambda ws: "\n".join(" ".join(ws[i : i + 13]) for i in range(0, len(ws), 13)) if as_block else " ".join(ws)
        gap = "\n \n" if as_block else "\n"
        for i, x in ((100 + k, a), (200 + k, b)):
            rows.append((i, f"É {prose(30)}.{gap}{wrap(x)}{gap}{prose(40)}"))
            first[i] = wrap(x)
    apart = prose(60).split()  # three changes: 41 of 71 shingles
    rows += [(300, " ".join(apart)), (301, " ".join(f"z{i}" if i in (12, 28, 44) else x for i, x in enumerate(apart)))]
    docs = table(spark, rows)
    by = dict(rows)
    got = P.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} <= set(first) and all(r.kept_in == 100 + r.doc_id % 100 for r in got)
    whole = {r.doc_id for r in got if first[r.doc_id] in by[r.doc_id][r.start : r.end]}  # a window may add a word or two
    assert len(whole) >= 54  # of 60: bands find a pair of similarity 0.75 with probability 0.95
    left = {r.doc_id: r.text for r in P.remove_passages(docs).collect()}
    assert all((first[i] in left[i]) == (i < 200) for i in whole)


def similarity(a, b):
    s, t = windows(a, 5), windows(b, 5)
    return len(s & t) / max(1, len(s | t))


def test_recall_of_natural_paragraphs_against_all_pairs(spark):
    """Words of paragraphs of similarity 0.75 and more to one of an earlier document: at least nine in ten are found, others never."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(4, 9)))
    paragraphs, n = [], 0
    for _ in range(40):
        size = rnd.choice([40, 60, 120, 200])
        base = [word() for _ in range(size)]
        for step in (None, 28, 34, 40, 60, 12):
            copy = [word() if step and i % step == step // 2 else w for i, w in enumerate(base)]
            paragraphs.append((n := n + 1, " ".join(copy)))
    rnd.shuffle(paragraphs)
    rows = [(i, f"{word()} {word()}.\n\n{p}\n\n{' '.join(word() for _ in range(30))}") for i, p in paragraphs]
    by, text = dict(paragraphs), dict(rows)
    ids = sorted(by)
    like = {(a, b): similarity(by[a], by[b]) for a in ids for b in ids if a < b and abs(a - b) < 6}
    want = {b for (a, b), s in like.items() if s >= 0.75}
    got = [r for r in P.repeated_passages(table(spark, rows)).collect() if r.removed]
    words_of = lambda t: len(WORD.findall(lower_az(t)))
    hit = {}
    for r in got:
        begin = text[r.doc_id].index(by[r.doc_id])
        inside = text[r.doc_id][max(begin, r.start) : min(begin + len(by[r.doc_id]), r.end)]
        hit[r.doc_id] = hit.get(r.doc_id, 0) + words_of(inside)
        assert begin - 20 <= r.start and r.end <= begin + len(by[r.doc_id]) + 20  # a window may reach over by a word or two
    total = sum(words_of(by[i]) for i in want)
    found = sum(min(hit.get(i, 0), words_of(by[i])) for i in want)
    print("words of near copies found", found / total, "of", len(want))
    assert len(want) > 60 and found >= 0.9 * total
    assert all(any(windows(by[r.doc_id], 20) & windows(by[a], 20) or similarity(by[a], by[r.doc_id]) >= 0.75 for a in ids if a != r.doc_id and abs(a - r.doc_id) < 6) for r in got)


def test_copies_of_whole_texts(spark):
    t = " ".join(f"w{i * 37 % 1009}" for i in range(60))
    got = {(r.doc_id, r.removed, r.start, r.end, r.kept_in) for r in P.repeated_passages(table(spark, [(3, t), (5, t), (4, t), (4, t), (9, "few words"), (8, "few words"), (None, t)])).collect()}
    assert got == {(3, False, 0, len(t), 3), (4, True, 0, len(t), 3), (5, True, 0, len(t), 3)}
