"""Texts with nulls, empty and very long values, copies and near copies."""

LONG = "the quick brown fox jumps over the lazy dog again and again " * 2500
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE + " tail"
TEXTS = [
    (1, "Hello  World\nhello world\nHello  World"), (2, None), (3, ""), (4, " \t\n\x0b "), (5, LONG), (6, BASE), (7, NEAR), (8, BASE), (8, BASE),
    (9, BASE.upper()), (10, "a b"), (11, "A  B"), (12, "x <|endoftext|> y ▁ été ∀"), (None, BASE), (None, "lonely words that nobody else has here at all"),
    (13, BASE.replace("word5 ", "other ")), (14, " ".join(f"w{i % 9}" for i in range(200))), (15, "# $ % && || <> ***"), (16, "ok\r\n\r\nok\r\nfine"),
]
