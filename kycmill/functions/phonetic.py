"""Double Metaphone codes (Lawrence Philips' published algorithm), not cut to four letters.

The algorithm is a list of spelling rules, so it is written as one: each row is a pattern that
consumes letters where it stands, the primary and the secondary sound, and optionally the kind of
name it holds for. The first row that fits at a position wins; letters without a row are silent.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

V = "[AEIOUY]"
GERMANIC = r"(?<=^(?:VAN |VON |SCH).*)"
ANY, SLAVIC, OTHER = "any", "slavic", "other"

# The spelling rules of the published algorithm, in its order.
RULES = [
    (r"^[GKP](?=N)|^W(?=R)|^P(?=S)", "", "", ANY),
    (r"^X", "S", "S", ANY),
    (rf"^{V}", "A", "A", ANY),
    (r"BB?", "P", "P", ANY),
    (r"(?<=[^AEIOUY]A)CH(?![IE])|(?<=[BM]A)CH(?=ER)", "K", "K", ANY),
    (r"^C(?=AESAR)A", "S", "S", ANY),
    (r"CH(?=IA)", "K", "K", ANY),
    (r"(?<=.)CH(?=AE)", "K", "X", ANY),
    (r"^CH(?=ARAC|ARIS|OR(?!E)|YM|IA|EM)", "K", "K", ANY),
    (rf"{GERMANIC}CH", "K", "K", ANY),
    (r"(?<=OR)CH(?=ES|ID)|(?<=AR)CH(?=IT)", "K", "K", ANY),
    (r"CH(?=[TS])|(?:(?<=[AOUE])|^)CH(?=[LRNMBHFVW])", "K", "K", ANY),
    (r"(?<=^MC.*)CH|(?<=^M)CH", "K", "K", ANY),
    (r"(?<=.)CH", "X", "K", ANY),
    (r"CH", "X", "X", ANY),
    (r"(?<!WI)CZ", "S", "X", ANY),
    (r"CCI(?=A)", "X", "X", ANY),
    (r"(?<=^A)CC[IEH](?<!H(?=U))|(?<=U)CCE(?=E|S)", "KS", "KS", ANY),
    (r"(?<!^M)CC[IEH](?<!H(?=U))", "X", "X", ANY),
    (r"(?<!^M)CC|C[KGQ]", "K", "K", ANY),
    (r"C(?=I[OEA])I", "S", "X", ANY),
    (r"C[IEY]", "S", "S", ANY),
    (r"C [CQG]", "K", "K", ANY),
    (r"C(?:[KQ]|C(?![EI]))?", "K", "K", ANY),
    (r"DG[IEY]", "J", "J", ANY),
    (r"DG", "TK", "TK", ANY),
    (r"D[TD]?", "T", "T", ANY),
    (r"FF?", "F", "F", ANY),
    (r"(?<=[^AEIOUY])GH", "K", "K", ANY),
    (r"^GH(?=I)", "J", "J", ANY),
    (r"^GH", "K", "K", ANY),
    (r"(?<=^..?)G(?=H)", "", "", ANY),
    (r"(?<=[BHD].)GH|(?<=[BHD]..)GH|(?<=[BH]...)GH", "", "", ANY),
    (r"(?<=[CGLRT].U)GH", "F", "F", ANY),
    (r"(?<=[^I])GH", "K", "K", ANY),
    (r"G(?=H)", "", "", ANY),
    (rf"(?<=^{V})GN", "KN", "N", OTHER),
    (r"GN(?!EY)", "N", "KN", OTHER),
    (r"GN", "KN", "KN", ANY),
    (r"GL(?=I)", "KL", "L", OTHER),
    (r"^G(?:Y|E(?=[SPBLYIR])|I(?=[BLNE]))", "K", "J", ANY),
    (r"(?<!^[DRM]AN(?=GER)|^[DRM]ANGER.*)(?<![EI])G(?:E(?=R)|(?<![RO]G)Y)", "K", "J", ANY),
    (rf"{GERMANIC}G(?:[EIY]|G(?<=[AO]GG)(?=I))|GE(?=T)", "K", "K", ANY),
    (r"GI(?=ER(?: |$))", "J", "J", ANY),
    (r"G[EIY]|(?<=[AO])GG(?=I)", "J", "K", ANY),
    (r"GG?", "K", "K", ANY),
    (rf"(?:^|(?<={V}))H{V}", "H", "H", ANY),
    (r"(?<=^SAN .*)JJ?|^J(?=OSE(?: |$))", "H", "H", ANY),
    (r"J(?=OSE)", "J", "H", ANY),
    (r"^JJ?", "J", "A", ANY),
    (rf"(?<={V})J(?=[AO])", "J", "H", OTHER),
    (r"J$", "J", " ", ANY),
    (r"(?<![SKL])J(?![LTKSNMBZ])J?", "J", "J", ANY),
    (r"KK?", "K", "K", ANY),
    (r"(?:(?<=I)LL(?=[OA]$)|(?<=A)LL(?=E$)|(?<=A)LL(?=E.*(?:[AO]S|[AO])$))", "L", "", ANY),
    (r"LL?", "L", "L", ANY),
    (r"(?<=U)MB(?=$|ER)", "M", "M", ANY),
    (r"MM?", "M", "M", ANY),
    (r"NN?", "N", "N", ANY),
    (r"PH", "F", "F", ANY),
    (r"P[PB]?", "P", "P", ANY),
    (r"QQ?", "K", "K", ANY),
    (r"(?<=IE)(?<!M[EA]IE)R$", "", "R", OTHER),
    (r"RR?", "R", "R", ANY),
    (r"(?<=[IY])S(?=L)", "", "", ANY),
    (r"^S(?=UGAR)", "X", "S", ANY),
    (r"SH(?=EIM|OEK|OLM|OLZ)", "S", "S", ANY),
    (r"SH", "X", "X", ANY),
    (r"SI[OA]", "S", "X", OTHER),
    (r"SI[OA]", "S", "S", ANY),
    (r"^S(?=[MNLW])|SZ", "S", "X", ANY),
    (r"SCH(?=E[RN])", "X", "SK", ANY),
    (r"SCH(?=OO|UY|E[DM])", "SK", "SK", ANY),
    (r"^SCH(?![AEIOUYW])", "X", "S", ANY),
    (r"SCH", "X", "X", ANY),
    (r"SC[IEY]", "S", "S", ANY),
    (r"SC.?", "SK", "SK", ANY),
    (r"(?<=[AO]I)S$", "", "S", ANY),
    (r"S[SZ]?", "S", "S", ANY),
    (r"TI(?=ON)O|TIA|TCH", "X", "X", ANY),
    (rf"TH(?=[OA]M)|{GERMANIC}TT?H", "T", "T", ANY),
    (r"TH|TT(?=H)", "0", "T", ANY),
    (r"T[TD]?", "T", "T", ANY),
    (r"VV?", "F", "F", ANY),
    (r"WR", "R", "R", ANY),
    (rf"^W(?={V})", "A", "F", ANY),
    (r"^W(?=H)", "A", "A", ANY),
    (rf"(?<={V})W$|(?<=[EO])W(?=SK[IY])|(?<=^SCH.*)W", "", "F", ANY),
    (r"WI[CT]Z", "TS", "FX", ANY),
    (r"(?<!(?:[IE]A|[AO])U)X$", "KS", "KS", ANY),
    (r"X[CX]|X(?!$)", "KS", "KS", ANY),
    (r"ZH", "J", "J", ANY),
    (r"ZZ(?=[OIA])", "S", "TS", ANY),
    (r"(?<=[^T])ZZ?", "S", "TS", SLAVIC),
    (r"ZZ?", "S", "S", ANY),
]


@lru_cache(maxsize=None)
def _compiled(kind: str):
    rows = [r for r in RULES if r[3] in (ANY, kind)]
    return regex.compile("|".join(f"({r[0]})" for r in rows)), [r[1:3] for r in rows]


def double_metaphone(name: str) -> tuple[str, str]:
    """Primary and secondary code; the secondary is empty when both are the same."""
    plain = unicodedata.normalize("NFD", name.replace("Ç", "S").replace("ç", "s"))
    text = "".join(c for c in plain if unicodedata.category(c) != "Mn").upper()
    kind = SLAVIC if regex.search("W|K|CZ", text) else OTHER
    pattern, sounds = _compiled(kind)
    found = [sounds[m.lastindex - 1] for m in pattern.finditer(text)]
    primary, secondary = "".join(p for p, _ in found), "".join(s for _, s in found)
    return primary, "" if secondary == primary else secondary


@F.pandas_udf(T.ArrayType(T.StringType()))
def _codes(names: pd.Series) -> pd.Series:
    known = {n: [c for c in double_metaphone(n) if c] for n in names.dropna().unique()}
    return names.map(lambda n: known.get(n, []))


def phonetic_codes(name: Column) -> Column:
    """Non-empty codes of a whole name, as an array of at most two.

    Runs where the rows are, once per distinct name of a batch: no shuffle, and a name that fills a
    third of the table costs one evaluation per batch.
    """
    return _codes(name)
