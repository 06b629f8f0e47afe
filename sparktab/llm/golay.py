"""The binary Golay code of length 23: decoding, and the codewords near a word.

The code is perfect: every 23-bit word lies within 3 bits of exactly one codeword. A word
at distance 3 from its codeword has five more codewords at distance 4, any other word has
none, so each word has one or six codewords within 4 bits. Two words that differ in one bit
therefore agree on this: the codeword that one decodes to is among those near the other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, INFORMATION = 23, 12
#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the code.
GENERATOR = 0b110001110101
#: Stands for a missing pattern or codeword index.
NONE = 0xFFFFFFFF


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, LENGTH - INFORMATION - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (LENGTH - INFORMATION))
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each single bit; per remainder the error patterns of at most 4 bits, lightest first."""
    single = np.array([_remainder(1 << bit) for bit in range(LENGTH)], np.uint32)
    patterns: list[list[int]] = [[] for _ in range(1 << (LENGTH - INFORMATION))]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            error = sum(1 << bit for bit in bits)
            remainder = int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0
            if weight < 4 or len(patterns[remainder]) and patterns[remainder][0].bit_count() == 3:
                patterns[remainder].append(error)
    table = np.array([(row + [NONE] * 6)[:6] for row in patterns], np.uint32)
    return single, table


class Golay:
    """Indices of codewords for arrays of 23-bit words."""

    def __init__(self) -> None:
        self.single, self.patterns = _tables()

    def near(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) indices of the codewords within 4 bits, the decoded one first, NONE for want of others."""
        words = words.astype(np.uint32)
        remainder = np.zeros(len(words), np.uint32)
        for bit in range(LENGTH):
            remainder ^= np.where(words >> np.uint32(bit) & np.uint32(1), self.single[bit], np.uint32(0))
        errors = self.patterns[remainder]
        return np.where(errors == NONE, NONE, (words[:, None] ^ errors) >> np.uint32(LENGTH - INFORMATION))
