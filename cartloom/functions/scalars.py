"""Cleaning and shaping of single values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category codes of the engagement log.
MEDIA_CODES = {
    "": 0,
    "Photo": 1,
    "Photo\tPho": 2,
    "Video": 3,
    "GIF": 4,
    "Video\tVid": 5,
    "Photo\tVid": 6,
    "Video\tPho": 7,
    "GIF\tPhoto": 8,
    "Photo\tGIF": 9,
    "GIF\tGIF": 10,
    "GIF\tVideo": 11,
    "Video\tGIF": 12,
    "GIF\tGIF\tG": 13,
}
TWEET_TYPE_CODES = {"TopLevel": 0, "Retweet": 1, "Quote": 2}
# The 66 language hashes, coded by their place in this list.
LANGUAGE_HASHES = """
488B32D24BD4BB44172EB981C1BCA6FA E7F038DE3EAD397AEC9193686C911677
B0FA488F2911701DD8EC5B1EA5E322D8 B8B04128918BBF54E2E178BFF1ABA833
313ECD3A1E5BB07406E4249475C2D6D6 1F73BB863A39DB62B4A55B7E558DB1E8
9FCF19233EAD65EA6E32C2E6DC03A444 9A78FC330083E72BE0DD1EA92656F3B5
8729EBF694C3DAF61208A209C2A542C8 E6936751CBF4F921F7DE1AEF33A16ED0
7F4FAB1EB12CD95EDCD9DB2A6634EFCE B4DC2F82961F1263E90DF7A942CCE0B2
310ECD7D1E42216E3C1B31EFDDFC72A7 5A0759FB938B1D9B1E08B7A3A14F1042
2F548E5BE0D7F678E72DDE31DFBEF8E7 5B6973BEB05212E396F3F2DC6A31B71C
2573A3CF633EBE6932A1E1010D5CD213 DA13A5C3763C212D9D68FC69102DE5E5
00304D7356D6C64481190D708D8F739C 7D11A7AA105DAB4D6799AF863369DB9C
23686A079CA538645BF6118A1EF51C8B A5CFB818D79497B482B7225887DBD3AD
838A92D9F7EB57FB4A8B0C953A80C7EB 99CA116BF6AA65D70F3C78BEBADC51F0
D922D8FEA3EFAD3200455120B75BCEB8 159541FA269CA8A9CDB93658CAEC4CA2
E84BE2C963852FB065EE827F41A0A304 6B90065EA806B8523C0A6E56D7A961B2
4B55C45CD308068E4D0913DEF1043AD6 BAC6A3C2E18C26A77C99B41ECE1C738D
4CA37504EF8BA4352B03DCBA50E98A45 3228B1FB4BC92E81EF2FE35BDA86C540
D7C16BC3C9A5A633D6A3043A567C95A6 477ED2ED930405BF1DBF13F9BF973434
41776FB50B812A6775C2F8DEC92A9779 C1E99BF67DDA2227007DE8038FE32470
F70598172AC4514B1E6818EA361AD580 6744F8519308FD72D8C47BD45186303C
10C6C994C2AD434F9D49D4BE9CFBC613 89CE0912454AFE0A1B959569C37A5B8F
105008E45831ADE8AF1DB888319F422A DE8A3755FCEDC549A408D7B1EB1A2C9F
BF04E736C599E9DE22F39F1DC157E1F1 CF304ED3CFC1ADD26720B97B39900FFD
59BE899EB83AAA19878738040F6828F0 3DF931B225B690508A63FD24133FA0E2
3AB05D6A4045A6C37D3E4566CFDFFE26 678E280656F6A0C0C23D5DFD46B85C14
440116720BC3A7957E216A77EE5C18CF A3E4360031A7E05E9279F4D504EE18DD
C41F6D723AB5D14716D856DF9C000DED 7E18F69967284BB0601E88A114B8F7A9
F9D8F1DB5A398E1225A2C42E34A51DF6 914074E75CB398B5A2D81E1A51818CAA
5B210378BE9FFA3C90818C43B29B466B F33767F7D7080003F403FDAB34FEB755
DC5C9FB3F0B3B740BAEE4F6049C2C7F1 3EA57373381A56822CBBC736169D0145
37342508F52BF4B62CCE3BA25460F9EB 7168CE9B777B76E4069A538DC5F28B6F
0BB2C843174730BA7D958C98B763A797 CDE47D81F953D800F760F1DE8AA754BA
9D831A0F3603A54732CCBDBF291D17B7 5F152815982885A996841493F2757D91
82C9890E4A7FC1F8730A3443C761143E 8C64085F46CD49FA5C80E72A35845185
""".split()
LANGUAGE_CODES = {name: code for code, name in enumerate(LANGUAGE_HASHES)}
# The three sets of follower-count cut points.
FOLLOWER_CUTS = (222, 578, 1225, 3689)
FOLLOWER_CUTS_ALT = (240, 588, 1331, 3996)
FOLLOWER_CUTS_LOW = (92, 216, 442, 1064)
# Range of account creation seconds.
ACCOUNT_FIRST, ACCOUNT_SCALE_END = 1138308613, 1139000000


def fill(c: Column, value) -> Column:
    return F.coalesce(c, F.lit(value))


def fill_list(c: Column, value="missing") -> Column:
    """Null or empty list -> one-element list of the filler."""
    return F.when(F.size(F.coalesce(c, F.array())) > 0, c).otherwise(F.array(F.lit(value)))


def sentinel_to_null(c: Column, sentinel=0) -> Column:
    return F.nullif(c, F.lit(sentinel))


def flag(c: Column) -> Column:
    """1 where an event time is present and positive, else 0."""
    return F.when(c > 0, 1).otherwise(0)


def any_flag(*cs: Column) -> Column:
    return F.greatest(*[flag(c) for c in cs]) if len(cs) > 1 else flag(cs[0])


def bit_code(*flags: Column) -> Column:
    """Flags packed as bits, the first one least significant."""
    packed = F.lit(0)
    for place, one in enumerate(flags):
        packed = packed + one.cast("int") * F.lit(1 << place)
    return packed


def ternary_code(*flags: Column) -> Column:
    """Flags in {-1, 0, 1} as digits of a base-3 number, first digit lowest."""
    total = F.lit(0)
    for place, one in enumerate(flags):
        total = total + (one.cast("int") + F.lit(1)) * F.lit(3**place)
    return total


def code_of(c: Column, codes: Mapping[str, int], default: int = 0) -> Column:
    """Lookup in a small fixed table; anything else gets the default."""
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def media_pair(c: Column, sep: str = "\t") -> Column:
    """The first two media tokens joined by an underscore."""
    return F.array_join(F.slice(F.split(c, sep), 1, 2), "_")


def clip(c: Column, low=None, high=None) -> Column:
    if low is not None:
        c = F.greatest(c, F.lit(low))
    if high is not None:
        c = F.least(c, F.lit(high))
    return c


def wrap_byte(c: Column) -> Column:
    """Truncate to an integer and keep its low eight bits, signed."""
    return (F.pmod(c.cast("long") + 128, F.lit(256)) - 128).cast("byte")


def quantise(c: Column, bits: int = 8) -> Column:
    """A rate in 0..1 spread over the signed range of 8 or 16 bits."""
    span, kind = (255, "byte") if bits == 8 else (65535, "short")
    return (c * span - (span + 1) // 2).cast(kind)


def account_age_byte(c: Column) -> Column:
    """Account creation seconds scaled linearly into one byte."""
    floored = F.when(c < 0, ACCOUNT_FIRST).otherwise(c)
    scaled = 240 * (floored - ACCOUNT_FIRST) / (ACCOUNT_SCALE_END - ACCOUNT_FIRST) - 127
    return wrap_byte(scaled)


def bucket(c: Column, width: float) -> Column:
    return F.floor(c / width)


def threshold_group(c: Column, cuts: Sequence[float], inclusive: bool = True) -> Column:
    """How many cut points the value reaches (or, not inclusive, exceeds)."""
    steps = [((c >= q) if inclusive else (c > q)).cast("int") for q in cuts]
    total = steps[0]
    for step in steps[1:]:
        total = total + step
    return total


def ratio(a: Column, b: Column, guard: float = 0) -> Column:
    """a / (b + guard); null when the divisor is zero."""
    return F.try_divide(a, b + F.lit(guard) if guard else b)


def signed_log1p(c: Column) -> Column:
    return F.log1p(F.abs(c)) * F.signum(c)


def snap_even(c: Column, top: int = 10) -> Column:
    """Nearest of 0, 2, .. top; an odd number goes to the lower neighbour."""
    return F.least(F.lit(top), (F.floor(c / 2) * 2)).cast("int")
