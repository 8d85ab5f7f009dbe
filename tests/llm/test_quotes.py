import random
import re

from helixframe.llm import quotes


def norm(x):
    return re.sub(r"\s+", " ", x).strip(" ").lower()


def parse(text):
    lines = []
    for line in re.sub(r"\r\n?", "\n", text or "").split("\n"):
        marks = re.match(r"[ \t]*(?:>[ \t]*)+", line)
        lines.append((marks[0].count(">") if marks else 0, line[marks.end() if marks else 0 :]))
    own = "\n".join(c for n, c in lines if n == 0).strip()
    runs = []
    for i, (n, c) in enumerate(lines):
        if n and (i == 0 or lines[i - 1][0] != n):
            runs.append((n, [], [[]]))
        if n and norm(c):
            runs[-1][1].append(norm(c))
            runs[-1][2][-1].append(norm(c))
        elif n:
            runs[-1][2].append([])
    return own, [(n, x, [" ".join(p) for p in ps if p]) for n, x, ps in runs if x]


def brute(rows):
    done = [(c, t, role, *parse(x)) for c, t, role, x in rows]
    parent = {}
    said = [(c, t, {norm(own), *map(norm, re.split(r"\n[ \t]*\n", own)), *map(norm, own.split("\n"))} - {""}) for c, t, _, own, _ in done]
    for k, (c, t, _, _, runs) in enumerate(done):
        found = []
        for level, lines, paragraphs in runs:
            for whole, text in [(2, " ".join(lines)), *((1, x) for x in paragraphs), *((0, x) for x in lines)]:
                for c2, t2, texts in said:
                    if c is not None and t is not None and c2 == c and t2 is not None and t2 < t and text in texts:
                        found.append((-level, whole, len(text), t2))
        before = [t2 for c2, t2, *_ in done if c is not None and t is not None and c2 == c and t2 is not None and t2 < t]
        parent[k] = (max(found)[3], True) if found else (max(before), False) if before else (None, False)
    by_turn = {}
    for k, (c, t, *_) in enumerate(done):
        if parent[k][0] is not None:
            by_turn[c, t] = max(by_turn.get((c, t), -1), parent[k][0])
    out = []
    for k, (c, t, role, own, runs) in enumerate(done):
        thread, depth = t, 0
        while (c, thread) in by_turn:
            thread, depth = by_turn[c, thread], depth + 1
        out.append((c, thread, depth, t, *parent[k], role, own, len(runs)))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 4) for r in rows], "conv_id long, turn long, role string, text string, own string, row_key int")
    return sorted([tuple(r) for r in quotes.conversations(df).collect()], key=str)


def test_nested_quotes():
    own, runs = parse("> > deep one\n> shallow\n> two\n\nmine\n>only\n>\nend")
    assert own == "mine\nend" and runs == [(2, ["deep one"], ["deep one"]), (1, ["shallow", "two"], ["shallow two"]), (1, ["only"], ["only"])]


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in range(6):
        said = []
        for t in range(0, 60 if c else 700, rng.choice([1, 2])):
            own = [" ".join(rng.choice("Aa b cc d é".split()) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4))]
            quote = []
            if said and rng.random() < 0.7:
                q = rng.choice(said)
                pick = q if rng.random() < 0.5 else q[: rng.randrange(1, len(q) + 1)]
                quote = [rng.choice(["> ", ">", " >  "]) + x.upper() for x in pick]
                if rng.random() < 0.4:
                    quote = ["> > " + x for x in rng.choice(said)] + quote
            said.append(own)
            rows.append((c, t, "user", "\n".join(quote + own) if rng.random() < 0.7 else "\r\n".join([*own[:1], "", *quote, "", *own[1:]])))
    rows += [(0, 3, "user", "yes\nyes"), (0, 701, "user", "> yes yes\nno"), (0, 702, "a", "> yes yes\nno"), (0, 702, "b", "> nowhere\nelse"), (4, 800, "user", "first part\nof it\n\nsecond part\n\nthird"), (4, 801, "user", "so"), (4, 802, "user", "> first\n> part of\n> it\n>\n> second part\nyes"), (None, 1, "user", "> yes"), (2, None, "user", "> yes"), (3, 900, None, None), (3, 901, "user", ""), (3, 902, "user", "> \n>>"), rows[5]]
    want = brute(rows)
    assert got(spark, rows) == want and sum(r[5] for r in want) > 100 and max(r[2] for r in want) > 5


def test_empty_table(spark):
    assert got(spark, []) == []


def test_the_sql_of_unquoted_conversations(spark):
    import duckdb

    from helixframe.llm.registry import OP7_SQL

    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", None]), rng.choice([None, "", " a\r\nb \n", "Text  here"])) for c in range(30) for t in rng.sample(range(900), rng.randrange(1, 40))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    db = duckdb.connect()
    db.register("conversations", frame.toPandas())
    names = ["conv_id", "thread", "depth", "turn", "parent_turn", "quoted", "role", "text", "n_quotes"]
    want = db.execute(f"SELECT {', '.join(names)} FROM ({OP7_SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in quotes.conversations(frame).select(*names).collect())
