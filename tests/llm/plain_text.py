"""Plain-Python words and made-up prose."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(seed, n):
    """Words no other seed shares."""
    return " ".join(f"w{seed}x{(seed * 7919 + i * 31) % 1009}q{i}" for i in range(n))
