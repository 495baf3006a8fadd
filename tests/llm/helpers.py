"""Small documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(n=60, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abdeghiklmnorstuéß") for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def text(rnd, words, n, line=8):
    out = []
    for i in range(n):
        out.append(rnd.choice(words))
        out.append("\n" if i % line == line - 1 else " ")
    return "".join(out).strip()


def corpus(n=40, seed=3):
    """(doc_id, text) rows: random texts, exact and near copies, odd ones."""
    rnd, words = random.Random(seed), vocabulary(400)
    rows = [(i, text(rnd, words, rnd.randint(1, 120))) for i in range(n)]
    for i in range(0, n // 2, 5):
        t = rows[i][1].split(" ")
        rows.append((1000 + i, rows[i][1]))                                       # exact copy
        for j in range(3):                                                        # near copies
            u = list(t)
            u[rnd.randrange(len(u))] = "edited" + str(j)
            rows.append((2000 + 10 * i + j, " ".join(u)))
    rows += [(3000, None), (3001, ""), (3002, " \n\t "), (3003, text(rnd, words, 5000)), (3004, "one two"), (3005, "ONE Two")]
    return rows


def frame(spark, rows, extra=()):
    full = [(d, t, "en", f"s{(d or 0) % 3}" if d != 3004 else None, len(t or "")) for d, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for c in extra:
        from pyspark.sql import functions as F
        df = df.withColumn(c, F.lit(7))
    return df
