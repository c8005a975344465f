"""Small documents with the cases every operator has to stand: nulls, empty and long texts, repeats, odd columns."""

LONG = "word1 Word2, wörd3. \n" * 4_000 + "x" * 3_000


def documents(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")


ODD = ["a b c", None, "", "   ", "a b c", "it's <|endoftext|> 'LL don't\t x", LONG, "é́ İ ΣΑΣ \x1c y", "!!!...,, a., ", "1234567 89", "q" * 40_000, LONG]
