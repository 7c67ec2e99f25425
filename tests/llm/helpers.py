import re

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    """Lower-cased words of a text, as the corpus operators split them."""
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
