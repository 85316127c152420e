import random
import re

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru", "te") for b in ("ban", "dor", "fis", "gul") for c in ("", "s", "et", "on")]


def prose(r, n):
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def near_copies(seed, n=60):
    r, rows = random.Random(seed), []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = rows[r.randrange(len(rows))][1]
            w = (w or "").split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            text = " ".join(w)
        else:
            text = prose(r, r.choice([1, 3, 6, 20, 60, 120]))
        rows.append((i * 3 + 1, text))
    return rows + [(500, None), (501, ""), (502, " \n\t"), (503, "a b"), (504, "A B")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
