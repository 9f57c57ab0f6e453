"""Numbering plans as a sorted index of number ranges: which lengths a range has and what its numbers are for. One binary search finds the range of a number, however many plans there are."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: region: (country code, trunk prefix, ranges). Ranges are `type prefix[-prefix],...:length[-length]`, of national numbers; the longest prefix that fits decides. Our own reading of the
#: public plans, and so approximate.
PLANS = {
    "PK": ("92", "0", "mobile 30-32,34,37,330-337,339,355,364:10 fixed_line 21,42:10 fixed_line 22-29,40-41,43-49,50-57,60-68,70-74,80-87,90-99:8-9 fixed_line 581-582,586:10 toll_free 800:8-11 premium_rate 900:8 personal_number 122:9 uan 21111,42111,51111:11"),
    "GB": ("44", "0", "fixed_line 1:9-10 fixed_line 2:10 mobile 71-75,77-79,7624:10 pager 76:10 personal_number 70:10 toll_free 800:7,9-10 toll_free 808:10 premium_rate 9,871-873:10 shared_cost 843-845,870:10 uan 3,55:10 voip 56:10"),
    "US": ("1", "1", "NANP"),
    "CA": ("1", "1", "NANP"),
    "AU": ("61", "0", "fixed_line 2-3,7-8:9 mobile 4:9 toll_free 1800:10 toll_free 180:7 shared_cost 13:6 shared_cost 1300:10 premium_rate 190:10 voip 147:9 pager 163:8-9"),
    "NL": ("31", "0", "fixed_line 10,13,15,111,113-115,117-118,161-162,164-168,172,174,180-184,186-187,20,23-24,26,222-224,226-229,251-252,255,294,297,299,30,33,35-36,38,313-318,320-321,341-348,40,43,45-46,411-413,416,418,475,478,481,485-488,492-493,495,497,499,50,53,55,58,511-519,521-525,527-529,541,543-548,561-562,566,570-573,575,577-578,591-599,70-79:9 "
           "mobile 61-65,68:9 pager 66:9 toll_free 800:7,10 premium_rate 900,906,909:7,10 voip 85,91:9 uan 88:9"),
    "DE": ("49", "0", "fixed_line 2,3-9:5-11 fixed_line 30,40,69,89:5-11 mobile 15:10-11 mobile 160,162-163:10 mobile 17:10-11 pager 164,168-169:7-14 voip 32:11 toll_free 800:10-13 premium_rate 900:10 shared_cost 180:7-11 personal_number 700:11 uan 18:6-14"),
    "FR": ("33", "0", "fixed_line 1-5:9 mobile 6,73-79,700:9 toll_free 800-805:9 shared_cost 81-82,884:9 premium_rate 836,89:9 voip 9:9 uan 806-809:9"),
    "BE": ("32", "0", "fixed_line 1-9:8 mobile 45-49:9 toll_free 800:8 premium_rate 90:8 shared_cost 78:8"),
    "ES": ("34", "", "fixed_line 81-88,91-98:9 mobile 6,71-74:9 toll_free 800,900:9 premium_rate 803,806-807:9 shared_cost 901-902:9 personal_number 70:9 uan 51:9"),
    "IT": ("39", "", "fixed_line 0:6-11 mobile 3:9-10 toll_free 800,803:6,9 premium_rate 892,895-899:6,9 shared_cost 840-841,847-848:6,9 personal_number 178:10 voip 55:10"),
    "PT": ("351", "", "fixed_line 21-29:9 mobile 91-93,96:9 toll_free 800,802:9 shared_cost 808-809:9 premium_rate 601,604,607,760-762:9 personal_number 884:9 voip 30:9 uan 703,708:9"),
    "IE": ("353", "0", "fixed_line 1:8 fixed_line 21-29,40-49,50-59,61-69,71,74,90-99:7-9 mobile 83-89:9 toll_free 1800:10 shared_cost 1850:10 premium_rate 1520,1530,1540,1550,1560,1570,1580,1590:10 personal_number 700:9 voip 76:9 uan 818:9"),
    "AT": ("43", "0", "fixed_line 1:4-13 fixed_line 2-5,61-64,72,74-77:4-13 mobile 650-653,655,657,659,66-69:7-13 toll_free 800:9-13 premium_rate 900,930,901,931,939:9-13 shared_cost 810,820-821:9-13 voip 720,780:9-13"),
    "CH": ("41", "0", "fixed_line 21-22,24,26-27,31-34,41,43-44,52,55-56,61-62,71,81,91:9 mobile 75-79,73:9 pager 74:9 toll_free 800:9 premium_rate 900-901,906:9 shared_cost 840,842,844,848:9 personal_number 878:9 uan 51,58:9 voicemail 860:12"),
    "SE": ("46", "0", "fixed_line 8:7-9 fixed_line 10-19,21-24,26-29,30-39,40-49,50-59,60,61-69,90-99:7-9 mobile 70,72-73,76,79:9 pager 74:9 personal_number 75:9 toll_free 20:6-9 shared_cost 77:6-9 premium_rate 900,939,944:7-10"),
    "NO": ("47", "", "fixed_line 2-3,51-53,55-57,61-64,66-67,69,70-79:8 mobile 4,59,9:8 toll_free 800-801:8 shared_cost 810:8 premium_rate 820,829:8 personal_number 880:8 voip 85:8 uan 0:5"),
    "DK": ("45", "", "fixed_line_or_mobile 2-9:8 toll_free 80:8 premium_rate 90:8"),
    "FI": ("358", "0", "fixed_line 13-19,21-28,31-38,51-58,61-68,81-88,90,92-99:5-9 mobile 40-48,50:6-10 toll_free 800:7-9 premium_rate 700,706,600:8-9 uan 10,20,29,30,71,73,75:5-10"),
    "PL": ("48", "", "fixed_line 12-18,22-25,29,32-34,41-44,46,48,52,54-56,58-59,61-63,65,67-68,71,74-77,81-87,89,91,94-95:9 mobile 45,50-51,53,57,60,66,69,72-73,78-79,88:9 pager 64:9 voip 39:9 toll_free 800:9 shared_cost 801:9 premium_rate 700-701,703-704,706-708:9 uan 804:9"),
    "CZ": ("420", "", "fixed_line 2,31-32,35,37-39,41,46-49,51,53-59:9 mobile 601-608,702-705,72-73,77,790-799:9 personal_number 700-701:9 toll_free 800:9 shared_cost 81,83-84:9 premium_rate 900,906,908-909:9 voip 910:9 uan 95-97:9"),
    "HU": ("36", "06", "fixed_line 1,22-29,32-37,42,44-49,52-57,59,62-63,66,68-69,72-79,82-85,87-89,92-96,99:8 mobile 20,30-31,50,70:9 voip 21:9 toll_free 80:8 premium_rate 90-91:8 shared_cost 40:8"),
    "RO": ("40", "0", "fixed_line 21,23-26,31,33-36:9 mobile 70-78:9 toll_free 800:9 shared_cost 801:9 personal_number 802:9 premium_rate 900,903,906:9 uan 37:9"),
    "GR": ("30", "", "fixed_line 21-28:10 mobile 685-689,69:10 toll_free 800:10 shared_cost 801,806,812,825:10 premium_rate 901,909:10 personal_number 70:10 uan 50:10"),
    "AE": ("971", "0", "fixed_line 2-4,6-7,9:8 mobile 50,52,54-56,58:9 toll_free 800:5-12 toll_free 400:6 premium_rate 9000,9002:9 shared_cost 7000,7005:9 uan 6002,6005:9"),
}
TYPES = ("mobile", "fixed_line", "fixed_line_or_mobile", "toll_free", "premium_rate", "shared_cost", "voip", "personal_number", "pager", "uan", "voicemail", "unknown")
_FREE, _PERSONAL = (800, 833, 844, 855, 866, 877, 888), (500, 521, 522, 533, 544, 566, 577, 588)
DIGITS = 15


def _each(spec: str) -> list[str]:
    """`30-32,34` as 30, 31, 32, 34."""
    out = []
    for part in spec.split(","):
        low, _, high = part.partition("-")
        out += [low] if not high else [str(x).zfill(len(low)) for x in range(int(low), int(high) + 1)]
    return out


def _nanp():
    """Area codes 2-9, 0-8, 0-9 but those that end in 11 or begin with 37 or 96; exchanges begin with 2 to 9."""
    for area in range(200, 1000):
        if area // 10 % 10 == 9 or area % 100 == 11 or area // 10 in (37, 96):
            continue
        kind = "toll_free" if area in _FREE else "premium_rate" if area == 900 else "personal_number" if area in _PERSONAL else "fixed_line_or_mobile"
        for exchange in range(2, 10):
            yield f"1{area}{exchange}", kind, 11, 11


@cache
def ranges() -> tuple[tuple[str, str, tuple[int, ...]], ...]:
    """(prefix with the country code, type, lengths with it) of all plans, sorted."""
    out: dict[str, tuple[str, set[int]]] = {}
    for cc, _, plan in dict.fromkeys(PLANS.values()):
        if plan == "NANP":
            for prefix, kind, low, _ in _nanp():
                out[prefix] = (kind, {low})
            continue
        words = plan.split()
        for kind, spec in zip(words[::2], words[1::2]):
            prefixes, lengths = spec.split(":")
            n = {int(x) + len(cc) for x in _each(lengths)}
            for p in _each(prefixes):
                out[cc + p] = (kind, out[cc + p][1] | n if cc + p in out and out[cc + p][0] == kind else n)
    return tuple((p, k, tuple(sorted(n))) for p, (k, n) in sorted(out.items()))


@cache
def index() -> tuple[list[int], list[int], list[str]]:
    """(lows, length masks, types) of disjoint ranges of numbers with DIGITS digits, from the least on; a range that is inside of another cuts it in two, and gaps have no lengths."""
    edges: dict[int, tuple[int, str]] = {0: (0, "unknown")}
    open_: list[tuple[int, int, str]] = []
    for prefix, kind, lengths in ranges():
        scale = 10 ** (DIGITS - len(prefix))
        low, end, mask = int(prefix) * scale, (int(prefix) + 1) * scale, sum(1 << n for n in lengths)
        while open_ and open_[-1][0] <= low:
            closed = open_.pop()[0]
            edges[closed] = open_[-1][1:] if open_ else (0, "unknown")
        edges[low] = (mask, kind)
        open_.append((end, mask, kind))
    while open_:
        closed = open_.pop()[0]
        edges[closed] = open_[-1][1:] if open_ else (0, "unknown")
    lows, last = [], None
    for x in sorted(edges):
        if edges[x] != last:
            lows.append(x)
            last = edges[x]
    return lows, [edges[x][0] for x in lows], [edges[x][1] for x in lows]


def _numbers(values: list[int], kind: str) -> Column:
    """An array literal; as one text in the plan, which Spark folds into an array once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def number_type(digits: Column) -> Column:
    """The type of a number given as its digits with the country code, or null if no plan has it."""
    lows, masks, types = index()
    # the last range that begins at or before the number: from the highest power of two down, step where the range there isn't beyond it
    steps = [1 << k for k in reversed(range(len(lows).bit_length()))]
    begins = _numbers(lows, "bigint")
    at = lambda key: F.aggregate(F.lit(steps), F.lit(0), lambda i, step: F.when(F.coalesce(F.get(begins, i + step) <= key, F.lit(False)), i + step).otherwise(i))
    kind = lambda i: F.get(F.lit(list(TYPES)), F.get(_numbers([TYPES.index(t) for t in types], "int"), i))
    fits = lambda d, i: F.when(F.bit_get(F.get(_numbers(masks, "int"), i), F.length(d)) == 1, kind(i))
    found = lambda d: bound(F.rpad(d, DIGITS, "0").cast("long"), lambda key: bound(at(key), lambda i: fits(d, i)))
    return bound(digits, lambda d: F.when((F.length(d) <= DIGITS) & d.rlike(r"^\d+$"), found(d)))
