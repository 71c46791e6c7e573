"""Addresses as text: validity, canonical form, public or not."""

from functools import reduce

from pyspark.sql import functions as F

from wardlog.functions.text import strip

# Blocks that are not publicly routable, and exceptions inside them.
PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4",
]
PUBLIC_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
# as leading hextets: (values, bits of the last one that count)
PRIVATE_V6 = [
    ("0:0:0:0:0:0:0:0", 16), ("0:0:0:0:0:0:0:1", 16), ("64:ff9b:1", 16), ("100:0:0:0", 16),
    ("2001:0", 7), ("2001:db8", 16), ("2002", 16), ("3fff:0", 4), ("fc00", 7), ("fe80", 10),
]
PUBLIC_V6 = [
    ("2001:1:0:0:0:0:0:1", 16), ("2001:1:0:0:0:0:0:2", 16), ("2001:3", 16), ("2001:4:112", 16),
    ("2001:20", 12), ("2001:30", 12),
]
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def let(value, body):
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v4_number(ip):
    number = lambda part: reduce(
        lambda n, i: n * 256 + F.get(part, F.lit(i)).try_cast("bigint"), range(1, 4),
        F.get(part, F.lit(0)).try_cast("bigint"),
    )
    return F.when(ip.rlike(V4), let(F.split(ip, r"\."), number))


def ipv4_number(ip):
    """The 32-bit number of a dotted address, null for anything else."""
    return let(ip, _v4_number)


def _in_v4(number, blocks):
    tests = []
    for block in blocks:
        base, bits = block.split("/")
        low = reduce(lambda n, o: n * 256 + int(o), base.split("."), 0)
        tests.append(number.between(low, low + 2 ** (32 - int(bits)) - 1))
    return reduce(lambda a, b: a | b, tests)


def _hex(number):
    return F.lower(F.hex(number.cast("bigint")))


def _hex_tail(ip):
    """Lower case, a dotted IPv4 tail written as two hextets."""
    head = F.regexp_extract(ip, r"^(.*:)[^:]*$", 1)
    dotted = lambda n: F.when(
        n.isNotNull(), F.concat(head, _hex(F.floor(n / 65536)), F.lit(":"), _hex(n % 65536))
    ).otherwise(F.lower(ip))
    return let(ipv4_number(F.regexp_extract(ip, r"([^:]*)$", 1)), dotted)


def _groups(side):
    return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))


def _filled(halves):
    """All hextets as text; :: stands for at least one zero."""

    def widen(sides):
        gap = 8 - F.size(sides["left"]) - F.size(sides["right"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)))
        return F.when(F.size(halves) == 1, sides["left"]).when(
            (F.size(halves) == 2) & (gap >= 1), F.concat(sides["left"], zeros, sides["right"])
        )

    right = F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
    return let(F.struct(_groups(F.get(halves, F.lit(0))).alias("left"), _groups(right).alias("right")), widen)


def hextets(ip):
    """The eight 16-bit numbers of an IPv6 address, null for anything else."""
    numbers = lambda parts: F.when(
        (F.size(parts) == 8) & F.forall(parts, lambda h: h.rlike("^[0-9a-f]{1,4}$")),
        F.transform(parts, lambda h: F.conv(h, 16, 10).cast("int")),
    )
    return let(ip, lambda t: F.when(
        F.contains(t, F.lit(":")),
        let(F.split(_hex_tail(t), "::", -1), lambda halves: let(_filled(halves), numbers)),
    ))


def _in_v6(numbers, blocks):
    tests = []
    for text, bits in blocks:
        *exact, last = [int(h, 16) for h in text.split(":")]
        test = F.floor(F.get(numbers, F.lit(len(exact))) / 2 ** (16 - bits)) == last >> (16 - bits)
        for i, value in enumerate(exact):
            test = test & (F.get(numbers, F.lit(i)) == value)
        tests.append(test)
    return reduce(lambda a, b: a | b, tests)


def _mapped_v4(numbers):
    """The IPv4 number inside ::ffff:a.b.c.d, else null."""
    zeros = reduce(lambda a, b: a & b, [F.get(numbers, F.lit(i)) == 0 for i in range(5)])
    value = F.get(numbers, F.lit(6)).cast("bigint") * 65536 + F.get(numbers, F.lit(7))
    return F.when(zeros & (F.get(numbers, F.lit(5)) == 0xFFFF), value)


def _public_v4(number):
    return ~_in_v4(number, PRIVATE_V4) | _in_v4(number, PUBLIC_V4)


def _public_v6(numbers):
    return let(
        _mapped_v4(numbers),
        lambda v4: F.when(v4.isNotNull(), _public_v4(v4)).otherwise(
            ~_in_v6(numbers, PRIVATE_V6) | _in_v6(numbers, PUBLIC_V6)
        ),
    )


def is_public_ip(ip):
    """Whether the text is a globally routable address; false for anything else."""
    known = lambda t: F.coalesce(
        let(ipv4_number(t), lambda n: F.when(n.isNotNull(), _public_v4(n))),
        let(hextets(t), lambda h: F.when(h.isNotNull(), _public_v6(h))),
        F.lit(False),
    )
    return let(strip(ip), known)


def _shortened(joined):
    """The first longest run of zero hextets replaced by ::."""
    short = joined
    for zeros in range(2, 9):
        run = r"(^|:)0(?::0){" + str(zeros - 1) + r"}(:|$)"
        once = F.concat(
            F.regexp_extract(joined, "^(.*?)" + run, 1), F.lit("::"),
            F.regexp_extract(joined, "^.*?" + run + "(.*)$", 3),
        )
        short = F.when(joined.rlike(run), once).otherwise(short)
    return short


def canonical_ip(ip):
    """Stripped dotted form, or the shortest lower-case IPv6 form; null if invalid."""
    v6 = lambda h: F.when(h.isNotNull(), let(F.array_join(F.transform(h, _hex), ":"), _shortened))
    return let(strip(ip), lambda t: F.when(t.rlike(V4), t).otherwise(let(hextets(t), v6)))
