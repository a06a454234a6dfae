import random

from pliegos.llm import line_dedup


def distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    """Each line against every earlier one."""
    seen, out = [], {}
    for k, text in sorted(rows):
        if text is None:
            out[k] = None
            continue
        kept = []
        for line in text.split("\n"):
            norm = line.lower().strip(" ")
            units = norm.split(" ") if norm.count(" ") >= 4 else list(norm)
            by_words = norm.count(" ") >= 4
            match = any(norm == n or (by_words == b and min(len(units), len(u)) >= (5 if b else 10) and distance_is_one(units, u)) for n, b, u in seen)
            if norm:
                seen.append((norm, by_words, units))
            if not norm or not match:
                kept.append(line)
        out[k] = "\n".join(kept)
    return out


def test_equals_comparison_with_every_earlier_line(spark):
    r = random.Random(2)
    lines = []
    for _ in range(25):
        base = [r.choice("abcdefgh") * r.randrange(1, 3) for _ in range(r.choice([1, 4, 5, 6, 9]))]
        for _ in range(6):
            line = list(base)
            for _ in range(r.randrange(0, 3)):
                at = r.randrange(len(line) + 1)
                line[at : at + r.randrange(0, 2)] = [r.choice("abcdefgh")] * r.randrange(0, 2)
            lines.append(" ".join(line) if r.random() < 0.8 else "  " + " ".join(line).upper())
    r.shuffle(lines)
    rows = [(k, "\n".join(lines[k * 6 : k * 6 + 6])) for k in range(25)] + [(90, None), (91, ""), (92, "\n\n")]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain(rows)
    assert {x.doc_id: x.text for x in out} == want
    assert {x.doc_id: x.n_lines for x in out} == {k: 0 if t is None else t.count("\n") + 1 for k, t in rows}


def test_short_lines_by_characters_and_long_unbroken_lines(spark):
    long = "ab" * 30_000
    rows = [
        (1, "see page ten\nrent\n" + long), (2, "see page tin\ncent\n" + long[:500] + "x" + long[500:]), (3, "see page then\nsee page\nsee pages\ntwo words here twice\ntwo words here twice more"),
        (4, "swapped page ten\npage swapped ten\n" + "xy" + long),
    ]
    out = {x.doc_id: x.text for x in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == plain(rows)
    assert out[2] == "cent"


def test_lines_with_the_same_neighbours_in_another_order_do_not_hide_a_match(spark):
    # the sums of the first two lines are equal, their variants are not
    lines = ["k the p q the r s the end", "k the r s the p q the end", "k the r s the p q the fin", "k the p q the r s the stop"]
    rows = [(k, x) for k, x in enumerate(lines)]
    out = {x.doc_id: x.text for x in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == plain(rows) == {0: lines[0], 1: lines[1], 2: "", 3: ""}


def test_very_frequent_line_keeps_one(spark):
    rows = [(k, f"the very same line of words\nown line number {k} x{k} y{k} z{k}") for k in range(400)]
    out = {x.doc_id: x.n_kept for x in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == 2 and set(out[k] for k in range(1, 400)) == {1}
