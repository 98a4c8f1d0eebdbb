"""Word hashes in plain integers, for brute-force versions."""

BITS = (1 << 64) - 1
C1, C2, C3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def mixed(h):
    h = (h ^ h >> 31) * C2 & BITS
    h = (h ^ h >> 29) * C3 & BITS
    return h ^ h >> 32


def word_hash(word: bytes) -> int:
    h = len(word) * C1 & BITS
    for i in range(0, len(word), 8):
        x = (h ^ int.from_bytes(word[i : i + 8], "little") * C2 & BITS) * C1 & BITS
        h = x ^ x >> 32
    return mixed(h)
