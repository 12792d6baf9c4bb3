"""Rows that every operator must bear: nulls, empty and very long texts, ties, repeated rows."""

EDGES = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, "The quick  brown\tfox jumps over the lazy dog"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "1234 !! ..."),
    (7, "Voilà l'été — 日本語 🙂 <|endoftext|> x  y\u0085z"),
    (8, "word " * 3000 + "end"),
    (9, "x" * 5000),
    (None, "a row without an id"),
    (10, "The quick brown fox jumps over the lazy dog"),
    (10, "The quick brown fox jumps over the lazy dog"),
]
