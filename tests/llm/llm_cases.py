"""Small documents with every awkward case, shared by the tests of the corpus operators."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "row string, fp string, kept string, n_words string, h string, norm string, at string, raw string, first string")
SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["an", "the", "er", "on", "ti", "ou", "é", "ß"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(160)
    a, b = prose(300), prose(300)
    long = prose(30_000)
    return [
        None, "", " \t\n\x0b\f\r ", "one", "two words", "\x1c odd \x85 space here   and  two",
        a, a, a.replace(" ", "\n"), a + " more", a.upper(), b[:700] + "X" + b[700:], b,
        prose(50) + " " + shared + " " + prose(70), prose(20) + "\n" + shared, shared + prose(3), "ab" * 900, "ab" * 450 + "c",
        "same line\nsame line\nother\n\nsame line\n" * 9, "# % & | < > $ * " * 20 + prose(40), long, long[5:60_000],
        'api_key = "abcdefgh1234" and token:short TOKEN=\'Zq9+x/7Kp0==aa\' AKIAABCDEFGHIJKL12 ' + "0123456789abcdef" * 3,
        "secret = password = hunter2hunter2", "x" * 31 + " " + "0" * 31 + " AKIA1234", "Kſecret = abcdefghij toKen = abcdefghij",
        "Released under the MIT License.\nfoo Licensed under the Apache License, Version 2.0. CC BY-NC 4.0",
        "This work is licensed under the very GNU General Public License, version 3.", "under the mit license " * 3,
        "12345 6789", "İstanbul ǅ straße don't we'll  \n\n  end ", "<|endoftext|> inside <|endoftext|>", "emoji 😀😀 é́ ퟿", prose(25), prose(19),
    ]


def rows():
    out = []
    for i, t in enumerate(texts()):
        doc = None if i == 4 else 500 if i in (7, 9) else i * 3
        extra = [f"x{i}"] * 9
        out.append((doc, t, [None, "en", "de"][i % 3], [None, "s1", "s1", "s2"][i % 4], i, *extra))
    return out + [out[6], out[0], out[20]]          # repeated rows


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(rows_):
    return sorted(map(repr, rows_))
