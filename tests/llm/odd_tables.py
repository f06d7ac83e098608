"""Schema and words of the tables in these tests."""

CLASHING = "id long, row long, hash long, key string, node long, text_sha256 string, _row long"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
EXTRA = (7, 7, 7, "k", 7, "s", 7)


def words(rng, n, alphabet="abcdefghijklmnop"):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(n))
