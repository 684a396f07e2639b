"""Line differences: applying them gives the new text, and plain changes are told as one would."""

import random

from tessella.operators import diffs

SCHEMA = "id int, old string, new string"


def changed(r, lines):
    out = list(lines)
    for _ in range(r.randrange(0, 6)):
        at = r.randrange(0, len(out) + 1)
        how = r.choice(["insert", "delete", "move", "replace"])
        if how == "insert":
            out[at:at] = [f"new {r.random()}" if r.random() < 0.6 else r.choice(["", "same"]) for _ in range(r.randrange(1, 4))]
        elif out and how == "delete":
            del out[at : at + r.randrange(1, 4)]
        elif out and how == "move":
            part = out[at : at + 3]
            del out[at : at + 3]
            to = r.randrange(0, len(out) + 1)
            out[to:to] = part
        elif out:
            out[at : at + 1] = ["other"]
    return out


def test_hunks_applied_give_the_new_text(spark):
    r = random.Random(6)
    pairs = []
    for i in range(120):
        lines = [r.choice(["", "same", "- item", f"line {r.randrange(30)}", f"line {r.random()}"]) for _ in range(r.randrange(0, 40))]
        pairs.append((i, "\n".join(lines), "\n".join(changed(r, lines))))
    pairs += [(200, None, "a\nb"), (201, "a\nb", None), (202, None, None), (203, "", "a"), (204, "a", ""), (205, "a\n", "a"), (206, "a", "a\n"), (207, "x\ny", "y\nx"), (208, "", None), (209, None, "")]
    pairs += [(300, "\n".join(f"{k}" for k in range(5000)), "\n".join(f"{k}" for k in range(5000) if k % 97))]
    df = spark.createDataFrame(pairs, SCHEMA)
    found = diffs.hunks(df)
    assert {x.id: x.text for x in diffs.applied(df, found).collect()} == {i: new for i, _, new in pairs}
    told = {x.id for x in found.select("id").distinct().collect()}
    assert told == {i for i, old, new in pairs if old != new}


def test_plain_changes(spark):
    old = "one\ntwo\nthree\nfour\nfive"
    df = spark.createDataFrame([(1, old, "one\ntwo\n2.5\nthree\nfour\nfive"), (2, old, "one\nthree\nfour\nfive!"), (3, old, old)], SCHEMA)
    got = {x.id: x.diff for x in diffs.unified(diffs.hunks(df)).collect()}
    assert got == {1: "@@ -2,0 +3,1 @@\n+2.5", 2: "@@ -2,1 +1,0 @@\n-two\n@@ -5,1 +4,1 @@\n-five\n+five!"}
