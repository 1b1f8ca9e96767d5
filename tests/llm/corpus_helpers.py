"""Helpers of the corpus tests."""

from collections import Counter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASHES = ("n", "key", "chunk", "bucket", "a", "b", "component", "slot", "fine", "row", "base", "label", "size", "segment")


def counted(df):
    """The rows as a multiset, by column name."""
    names = sorted(df.columns)
    return Counter(tuple(str(r[n]) for n in names) for r in df.collect())
