"""Passage removal against dictionaries of all windows and lines, and planted passages."""

import random
import re

from coldlake.llm import substring

SIZE = substring.WINDOW_WORDS
EDGE = SIZE // 2 - 1


def occurrences(rows, unit):
    """Ids of the documents that hold each tuple of words, found without hashing."""
    out = {}
    for rank, text in rows:
        for words in unit(text):
            out.setdefault(words, []).append(rank)
    return out


def windows(text, n):
    words = (text or "").lower().split()
    return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]


def long_lines(text, n):
    return [w for w in (tuple(x.lower().split()) for x in (text or "").split("\n")) if len(w) >= n]


def removed_words(row, text):
    """Whether each word of the text lies in a removed span."""
    spans = [(r["start"], r["end"]) for r in row["removed"]]
    return [any(s <= m.start() and m.end() <= e for s, e in spans) for m in re.finditer(r"\S+", text)]


def corpus(seed=1):
    draw = random.Random(seed)
    words = ["word%d" % k for k in range(3000)]

    def text(n):
        return " ".join(draw.choice(words) for _ in range(n))

    passages = [text(n) for n in (60, 90, 140)]
    rows, planted = [], {}
    for k in range(60):
        body = text(draw.randint(20, 200))
        if k % 3 == 0:
            p = draw.choice(passages)
            at = draw.randrange(len(body.split()))
            parts = body.split()
            body = " ".join(parts[:at]) + " " + p + " " + " ".join(parts[at:])
            planted[k] = p
        rows.append((k, body))
    return rows, planted


def test_passages_in_the_middle_of_lines(spark):
    rows, planted = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs).collect()}
    seen = set()
    for k, text in rows:
        r = got[k]
        assert r["text"] == text
        if k in planted and planted[k] in seen:
            size = len(planted[k].split())
            assert r["removed_words"] >= 0.6 * size and r["removed_words"] <= size + 4
            for span in r["removed"]:
                assert " ".join(text[span["start"] : span["end"]].split()[2:-2]) in planted[k]
                assert span["first_id"] < k
        else:
            assert r["removed_words"] == 0 and r["kept_text"] == text and r["removed"] == []
        if k in planted:
            seen.add(planted[k])


def test_against_all_windows_and_lines(spark):
    """Sound: what goes has an earlier place. Complete: long repeats go but for their edges."""
    rows, _ = corpus(2)
    draw = random.Random(5)
    fresh = lambda n: " ".join("z%d" % draw.randrange(10**9) for _ in range(n))
    lines = [fresh(n) for n in (3, 12, 31, 32, 40, 46, 80)]
    for k in range(60):
        rows.append((100 + k, "\n".join([fresh(9), draw.choice(lines), fresh(4), draw.choice(lines).upper(), fresh(9)])))
    earlier_windows = occurrences(rows, lambda t: windows(t, SIZE))
    earlier_lines = occurrences(rows, lambda t: long_lines(t, SIZE))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs).collect()}
    for k, text in rows:
        words, gone = text.lower().split(), removed_words(got[k], text)
        may, must = [False] * len(words), [False] * len(words)
        held = [min(earlier_windows[w]) < k or w in windows(text, SIZE)[:n] for n, w in enumerate(windows(text, SIZE))]
        for n, repeated in enumerate(held):
            if repeated:
                may[n : n + SIZE] = [True] * SIZE
        at = 0
        for line in text.split("\n"):
            line = tuple(line.lower().split())
            if len(line) >= SIZE and min(earlier_lines[line]) < k:
                may[at : at + len(line)] = must[at : at + len(line)] = [True] * len(line)
            at += len(line)
        run = 0
        for n, repeated in enumerate([*held, False]):
            if repeated:
                run += 1
            elif run:
                first, last = n - run, n + SIZE - 1  # words of the repeated passage
                if last - first >= SIZE + SIZE // 2 - 1:
                    must[first + EDGE : last - EDGE] = [True] * (last - first - 2 * EDGE)
                run = 0
        assert all(m or not g for g, m in zip(gone, may)), k
        assert all(g or not m for g, m in zip(gone, must)), k
        assert got[k]["removed_words"] == sum(gone)
        assert got[k]["kept_text"].split() == [w for w, g in zip(text.split(), gone) if not g]


def test_odd_rows(spark):
    line = " ".join("word%d" % k for k in range(40))
    rows = [(200, None), (201, ""), (202, " \n\n "), (203, f"{line}\nshort own text\n{line}"), (204, f"a\n  {line.upper()}\nb")]
    rows += [(205, "same " * 9000), (206, "same " * 9000), (203, f"{line}\nshort own text\n{line}"), (None, f"{line}\nnull id"), (None, "x")]
    docs = spark.createDataFrame([(*r, "x", 1, [2]) for r in rows], "doc_id long, text string, row string, removed int, cut array<int>").repartition(4)
    done = substring.remove_repeats(docs)
    assert sorted(done.columns) == sorted(["doc_id", "text", "row", "cut", "removed", "removed_words", "kept_text"])
    got = sorted((str(r["doc_id"]), r["kept_text"].split(), r["removed_words"]) for r in done.collect())
    twice = [*line.split(), "short", "own", "text"]
    want = [("200", [], 0), ("201", [], 0), ("202", [], 0), ("203", twice, 40), ("203", twice, 40), ("204", ["a", "b"], 40)]
    want += [("205", ["same"] * SIZE, 9000 - SIZE), ("206", [], 9000), ("None", ["null", "id"], 40), ("None", ["x"], 0)]
    assert got == sorted(want)


def test_empty(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def kept_words(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    return {r["doc_id"]: r["kept_text"].split() for r in substring.remove_repeats(docs, **options).collect()}


def test_every_passage_over_fifty_words_goes_in_any_layout(spark):
    draw = random.Random(3)
    fresh = iter(range(10**9))
    words = lambda n: ["w%d" % next(fresh) for _ in range(n)]
    rows, passages = [], []
    for k in range(400):
        passage = words(draw.choice((51, 55, 60)))
        passages.append(set(passage))
        for doc in (2 * k, 2 * k + 1):
            # laid out in lines of one to three words, or as one line, between unique text
            flow = " ".join(passage) if k % 2 else "".join(w + draw.choice(("\n", " ", "\n")) for w in passage)
            rows.append((doc, " ".join(words(9)) + draw.choice((" ", "\n")) + flow + " " + " ".join(words(9))))
    kept = kept_words(spark, rows)
    for k, passage in enumerate(passages):
        assert passage <= set(kept[2 * k])
        assert len(kept[2 * k + 1]) <= 18 + 2 * EDGE


def test_periodic_text_keeps_its_first_place(spark):
    kept = kept_words(spark, [(1, "again " * 500), (2, "a b c " * 40), (3, "x y " + "again " * 60)])
    assert kept[1] == ["again"] * SIZE and set(kept[2]) == {"a", "b", "c"} and kept[3][:2] == ["x", "y"] and len(kept[3]) <= 4


def test_lines_of_any_length_go_on_request(spark):
    draw = random.Random(4)
    fresh = iter(range(10**9))
    words = lambda n: " ".join("w%d" % next(fresh) for _ in range(n))
    lines = [words(n) for n in (1, 2, 3, 4, 9, 11, 12, 15, 20, 45) for _ in range(5)]
    rows, own = [], {}
    for k in range(150):
        own[k] = [words(7) for _ in range(2)]
        line = lines[k % 50]
        rows.append((k, f"{own[k][0]}\n{draw.choice(('', '  '))}{line.upper() if k > 99 else line.replace(' ', '  ')}\n{own[k][1]}"))
    rows.append((150, f"{words(5)}\n{lines[0]} and more\nq\n\nq"))
    kept = kept_words(spark, rows, line_words=1)
    for k in range(150):
        assert kept[k] == " ".join([own[k][0], *([lines[k]] if k < 50 else []), own[k][1]]).split()
    assert kept[150][5:] == [lines[0], "and", "more", "q"]  # a part of a line is not a line


def test_short_repeats_stay(spark):
    rows = [(k, f"own{k} text of document {k}\nAll rights reserved.\nLicensed to all who read this line of ten words\nend{k}") for k in range(40)]
    assert kept_words(spark, rows) == {k: t.split() for k, t in rows}
