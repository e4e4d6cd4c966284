"""Character classes, and folding of case and width.

Classes are bodies of regular expression brackets that Java, RE2 and Python read alike: digits ``m``, letters ``e`` and
sentence separators ``w``. Everything else, Han characters, blanks and symbols included, is an ordinary character that
the dictionary matcher works on; CR and LF are always tokens of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of each class.
CJK_NUMERALS = "零〇一二三四五六七八九十壹贰叁肆伍陆柒捌玖拾个百千万亿兆仟佰"
ASCII_SEPARATORS = "!\"',.:;?"
CJK_SEPARATORS = "、，‘’！？。“”：＂＇｀〃"

# Symbols that fold to ASCII, each above its target.
FOLD_FROM = "／￥＃％！＊（）－＋＝｛｝［］、｜；：‘“《》〈〉？～｀"
FOLD_TO = "/$#%!*()-+={}[],|;:'\"<><>?~`"


@dataclass(frozen=True)
class CharClasses:
    m: str
    e: str
    w: str

    def any_of(self, *names: str) -> str:
        return "".join(getattr(self, n) for n in names)


def default_classes(cjk_numerals: bool = True) -> CharClasses:
    """Digits, Latin letters and separators; z and Z count as letters in both widths."""
    return CharClasses(m="0-9０-９" + (CJK_NUMERALS if cjk_numerals else ""), e="A-Za-zÀ-þａ-ｚＡ-Ｚ", w=ASCII_SEPARATORS + CJK_SEPARATORS)


def letters_as_words() -> CharClasses:
    """Letters are ordinary characters for the matcher, and blanks separate."""
    return CharClasses(m="0-9０-９", e="", w=ASCII_SEPARATORS + CJK_SEPARATORS + " \\t")


def piece_pattern(classes: CharClasses, merge: bool = False, separate: bool = False, joint: str = "", star: str = "*") -> str:
    """A pattern whose matches tile a text: line ends, separators, letter and digit runs, runs of ordinary characters."""
    return "|".join(x for x in ("[\\r\\n]", f"[{classes.w}]" if classes.w else "", me_pattern(classes, merge, separate, joint, star), f"[^\\r\\n{classes.any_of('m', 'e', 'w')}]+") if x)


#: The star of groups for Java, which keeps a stack frame for each pass of a plain one, so that a run of some thousand
#: characters overflows a thread's stack; RE2 lacks it. A run's star ends its pattern, so both match the same.
JAVA_STAR = "*+"


def me_pattern(classes: CharClasses, merge: bool = False, separate: bool = False, joint: str = "", star: str = "*") -> str:
    """Letter and digit runs. A run goes on by the class of its first character, which later characters don't change;
    a joint character, and whatever follows one, belongs to the run; ``separate`` keeps digits out of any continuation."""
    m, e = classes.m, classes.e
    if not m and not e:
        return ""
    held = _inside(joint)
    after = f"(?:[^\\r\\n{held}{m if separate else ''}])?"

    def run(first: str, same: str) -> str:
        more = ("" if separate and same == m else same) + (e if merge and same == m else "") + (m if merge and same == e and not separate else "")
        glue = _inside(c for c in joint if not (separate and re.match(f"[{m}]", c)))
        steps = ([f"[{glue}]+{after}"] if glue else []) + ([f"[{more}]"] if more else [])
        own = _inside(c for c in joint if re.match(f"[{first}]", c))
        head = f"(?:[{own}]{after}|[{first}])" if own else f"[{first}]"
        return head + (f"(?:{'|'.join(steps)}){star}" if steps else "")

    return "|".join(run(c, c) for c in (m, e) if c)


def _inside(chars) -> str:
    """Characters as the body of a bracket."""
    return "".join("\\" + c if c in "\\]^-[" else c for c in chars)


def kind_of(piece: Column, classes: CharClasses) -> Column:
    """newline, separator, number, letter or run, by a piece's first character."""
    head = F.substring(piece, 1, 1)
    out = F.when(head.isin("\r", "\n"), "newline")
    for body, name in ((classes.w, "separator"), (classes.m, "number"), (classes.e, "letter")):
        if body:
            out = out.when(F.rlike(head, F.lit(f"[{body}]")), name)
    return out.otherwise("run")


def fold(text: Column) -> Column:
    """Lower case, full width letters, digits and listed symbols to ASCII."""
    wide = "".join(chr(c) for c in range(0xFF10, 0xFF1A)) + "".join(chr(c) for c in range(0xFF21, 0xFF3B)) + "".join(chr(c) for c in range(0xFF41, 0xFF5B))
    narrow = "".join(chr(ord(c) - 0xFEE0).lower() for c in wide)
    return F.translate(F.lower(text), wide + FOLD_FROM, narrow + FOLD_TO)


def fold_rules(lines, name: str = "value"):
    """Fold rules ``A->B``, ``U+hhhh->U+hhhh`` and ``A..B->C..D`` (comma separated, # comments) to (src, dst); the last rule wins.

    ``lines`` has the columns line_no and ``name``.
    """
    rule = r"^\s*(U\+[0-9A-Fa-f]{4,6}|.)(?:\.\.(U\+[0-9A-Fa-f]{4,6}|.))?\s*->\s*(U\+[0-9A-Fa-f]{4,6}|.)(?:\.\.(U\+[0-9A-Fa-f]{4,6}|.))?\s*$"
    parts = lines.select("line_no", F.posexplode(F.split(F.regexp_replace(name, "#.*$", ""), ",")).alias("nth", "rule")).where(F.rlike("rule", F.lit(rule)))

    def point(group: int) -> Column:
        got = F.regexp_extract("rule", rule, group)
        return F.when(got == "", F.lit(None)).when(got.startswith("U+") & (F.length(got) > 1), F.conv(F.substring(got, 3, 6), 16, 10).cast("int")).otherwise(F.ascii(got))

    spans = parts.select("line_no", "nth", point(1).alias("a"), point(2).alias("b"), point(3).alias("c"))
    each = spans.select("line_no", "nth", F.explode(F.sequence("a", F.coalesce("b", "a"))).alias("src"), (F.col("c") - F.col("a")).alias("shift"))
    return each.groupBy("src").agg(F.max_by(F.col("src") + F.col("shift"), F.struct("line_no", "nth")).alias("dst"))


def class_ranges(classes: CharClasses) -> list[tuple[int, int, str]]:
    """(first, last, class) code point ranges of the classes, in order."""
    out = []
    for name in ("m", "e", "w"):
        body = getattr(classes, name).replace("\\t", "\t")
        i = 0
        while i < len(body):
            to = body[i + 2] if i + 2 < len(body) and body[i + 1] == "-" else body[i]
            out.append((ord(body[i]), ord(to), name))
            i += 3 if to != body[i] else 1
    return sorted(out)
