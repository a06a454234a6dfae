import random

from pliegos.llm import decontaminate
from pliegos.llm.decontaminate import Q, WINDOW, aligned, edit_budget, normalised


def best_edits(window, text):
    """The fewest edits that turn a stretch of the text into the window, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def plain(text, item):
    text, item = normalised(text), normalised(item)
    if len(item) < Q:
        return bool(item) and f" {item} " in f" {text} "
    if len(text) < Q:
        return False
    n = min(WINDOW, len(item))
    starts = [*range(0, len(item) - n, decontaminate.STEP), len(item) - n]
    return any(best_edits(item[s : s + n], text) <= edit_budget(n) for s in starts)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(n))


def test_equals_alignment_of_every_window(spark):
    r = random.Random(4)
    items = [(k, prose(r, r.choice([2, 8, 20, 40]))) for k in range(8)] + [(8, "tiny"), (9, None), (10, "A b!"), (11, " - ")]
    docs = []
    for k in range(120):
        item = items[k % 8][1]
        at = r.randrange(max(1, len(item) - 120))
        part = list(item[at : at + 110])
        for _ in range(r.randrange(0, 14)):
            i = r.randrange(len(part))
            part[i : i + r.randrange(0, 2)] = [r.choice("abcxyz ,")] * r.randrange(0, 2)
        docs.append((k, prose(r, r.randrange(20)) + " " + "".join(part).upper() + " " + prose(r, r.randrange(20))))
    docs += [(600, "So TINY, a thing"), (601, "tinysized"), (602, "tiny"), (603, "a-b tiny a b"), (604, "a bc"), (500, None), (501, ""), (502, items[0][1]), (503, prose(r, 300))]
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, i) for d, t in docs for i, item in items if plain(t, item)}
    assert {(m.doc_id, m.item_id) for m in found} == want
    assert 20 < len(want) < 120
    texts = dict(docs)
    for m in found:
        assert m.edits <= edit_budget(WINDOW) and m.start >= 0 and m.start + m.length <= len(normalised(texts[m.doc_id]))


def test_parts_of_the_benchmark_give_the_same_rows(spark, sf_dir, monkeypatch):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.matches(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "PART_CHARACTERS", 2000)
    assert sorted(map(tuple, decontaminate.matches(docs, items).collect())) == whole
    kept = {r.doc_id for r in decontaminate.decontaminated(docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {m[0] for m in whole}


def test_aligned_gives_the_fewest_edits():
    r = random.Random(9)
    for _ in range(60):
        window = "".join(r.choice("abc") for _ in range(r.randrange(1, 20)))
        text = "".join(r.choice("abc") for _ in range(r.randrange(1, 40)))
        edits, start, end = aligned(window, text)
        assert edits == best_edits(window, text)
        assert 0 <= start <= end <= len(text)
