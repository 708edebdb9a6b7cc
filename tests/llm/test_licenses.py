"""Operator 8: alignment of long gaps, and licenses with scattered changes."""

import random

from tokenloom.llm import licenses


def _length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_halved_gaps_are_as_long_as_the_table_says(monkeypatch):
    draw = random.Random(5)
    for cells in (1, 7, 50):
        monkeypatch.setattr(licenses, "GAP_CELLS", cells)
        for _ in range(60):
            a = [draw.choice("abcd") for _ in range(draw.randint(0, 40))]
            b = [draw.choice("abcd") for _ in range(draw.randint(0, 40))]
            pairs = licenses._common(a, b)
            assert len(pairs) == _length(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_long_template_with_one_word_in_nine_replaced_is_found(spark):
    # every word occurs several times, so that there is no anchor and the gap is the whole template
    draw = random.Random(3)
    words = [f"w{draw.randrange(150)}" for _ in range(1500)]
    changed = ["other" if i % 9 == 4 else w for i, w in enumerate(words)]
    text = "before it. " + " ".join(changed) + " and after it"
    docs = spark.createDataFrame([(0, text), (1, " ".join(words)), (2, " ".join(sorted(words))), (3, None)], "doc_id int, text string")
    out, name = licenses.scan_licenses(docs, templates={"long": " ".join(words)})
    found = {r.doc_id: r[name] for r in out.collect()}
    assert [x["license"] for x in found[0]] == ["long"] and 0.88 < found[0][0]["coverage"] < 0.93
    assert text[found[0][0]["start"]:found[0][0]["end"]] == " ".join(changed)
    assert found[1][0]["coverage"] == 1.0 and found[2] == [] and found[3] == []
