import pytest

EDGE = [
    (None, "a text whose id is null, with some words in it to count and to compare with others", "en", None, 5),
    (1, None, "en", "src0", None),
    (2, "", "en", "src0", 0),
    (3, "   \n\t \n", None, "src1", 3),
    (4, "one", "en", "src1", 3),
    (5, "one two three", "en", None, 3),
    (6, "mail a.b@c.de or +1 (555) 123-4567 or 10.0.0.255 or 4111 1111 1111 1111 now\n# * $ % & | < >", "en", "src2", 3),
    (7, "été 日本語 🎉🎉  x\x00y \x1c z\u0085   end", "fr", "src2", 3),
]


def long_text(seed: int, n: int, words: int = 400) -> str:
    state, out = seed * 7919 + 13, []
    for k in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(f"w{state % words}" + ("\n" if k % 23 == 22 else " "))
    return "".join(out).replace(" \n", "\n")


@pytest.fixture(scope="session")
def docs(spark):
    """Edge cases, repeated rows, exact and near copies, one long text, and extra columns with clashing names."""
    rows = list(EDGE)
    rows += [(10 + k, long_text(k, 120 + 7 * k), "en", f"src{k % 3}", 1) for k in range(20)]
    base = long_text(3, 200)
    words = base.split(" ")
    rows += [(100 + k, base, "en", "src0", 1) for k in range(15)]
    for k in range(15):
        changed = list(words)
        changed[10 * k % len(changed)] = f"new{k}"
        rows.append((200 + k, " ".join(changed), "en", "src0", 1))
    rows += [(300, long_text(9, 6000), "en", "src1", 1), (301, "y" * 3000 + " " + "z" * 700, "en", "src1", 1)]
    rows += [rows[12], rows[12]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("own") for c in ("quality", "n_tokens", "ids", "copy", "shuffle_key", "sanitised", "id", "label", "measures", "n_lines", "_n", "_u", "_key", "_cdf", "_id", "_h", "_body", "_gone", "terms", "base", "gone", "mix_key", "found_id")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
