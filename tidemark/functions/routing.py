"""Key to partition: the 31-polynomial string hash over UTF-16 code units, sign bit cleared, modulo n.

Only the low 31 bits are ever needed, so clearing the others between blocks changes nothing and no LONG overflows."""

from pyspark.sql import Column, functions as F

MASK = 0x7FFFFFFF


def _long(value) -> Column:
    return F.lit(value).cast("long")


def _block(raw: Column, at: Column, size: int) -> Column:
    """``size`` bytes of a binary as one number; the first of them is below 0x80 or ``size`` is below 8."""
    return F.conv(F.hex(F.substring(raw, at * size + 1, F.lit(size))), 16, 10).cast("long")


def _folded(raw: Column, size: int, units: int, *steps) -> Column:
    """The polynomial over a binary in blocks of ``size`` bytes, joined by the power of 31 that spans a block.

    Zero bytes in front change nothing, so they fill the first block up. ``steps`` turn a block into its polynomial, one after
    the other, each over all blocks, since what a step uses more than once has to be bound to a variable.
    """
    power = _long(pow(31, units, MASK + 1))
    blocks = F.ceil(F.octet_length(raw) / F.lit(size)).cast("int")
    whole = F.lpad(raw, blocks * size, F.lit(b"\x00"))

    def folded(text):
        numbers = F.transform(F.sequence(F.lit(0), blocks - 1), lambda at: _block(text, at, size))
        for step in steps:
            numbers = F.transform(numbers, step)
        return F.aggregate(numbers, _long(0), lambda acc, x: (acc * power + x).bitwiseAND(_long(MASK)))

    return F.when(blocks > 0, F.get(F.transform(F.array(whole), folded), F.lit(0))).otherwise(_long(0))


# Eight units of one byte: neighbours are joined to pairs, pairs to fours, fours to the whole, side by side in one number.
_OF_BYTES = (
    lambda x: F.shiftright(x, 8).bitwiseAND(_long(0x00FF00FF00FF00FF)) * 31 + x.bitwiseAND(_long(0x00FF00FF00FF00FF)),
    lambda x: F.shiftright(x, 16).bitwiseAND(_long(0x0000FFFF0000FFFF)) * 31 ** 2 + x.bitwiseAND(_long(0x0000FFFF0000FFFF)),
    lambda x: F.shiftright(x, 32) * 31 ** 4 + x.bitwiseAND(_long(0xFFFFFFFF)))
# Three units of two bytes.
_OF_PAIRS = (
    lambda x: F.shiftright(x, 32) * 31 ** 2 + F.shiftright(x, 16).bitwiseAND(_long(0xFFFF)) * 31 + x.bitwiseAND(_long(0xFFFF)),)


def key_hash(key) -> Column:
    """Non-negative 31-bit hash of a string column, as LONG; 0 for an empty key, NULL for a NULL key.

    Text in ASCII goes in blocks of eight bytes, any other in blocks of three UTF-16 units: no object per character.
    """
    key = F.col(key) if isinstance(key, str) else key
    plain = F.octet_length(key) == F.char_length(key)
    return (F.when(key.isNull(), F.lit(None).cast("long"))
            .when(plain, _folded(key.cast("binary"), 8, 8, *_OF_BYTES))
            .otherwise(_folded(F.encode(key, "UTF-16BE"), 6, 3, *_OF_PAIRS)))


def key_partition(key, partitions: int) -> Column:
    if partitions < 1:
        raise ValueError("a topic has at least one partition")
    return (key_hash(key) % F.lit(partitions)).cast("int")
