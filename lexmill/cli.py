"""Command line: build dictionaries, or segment a text file.

    python -m lexmill.cli -u words.txt [-r] [-o folder]       build the unigram dictionary (-r: plain list of terms)
    python -m lexmill.cli -b synonyms.txt [-o folder]         build the synonym dictionary
    python -m lexmill.cli -t thesaurus.txt [-o folder]        build the thesaurus
    python -m lexmill.cli -d folder [-q] text.txt             segment a text with the folder's dictionaries
"""

from __future__ import annotations

import argparse
import contextlib
import sys

from lexmill import sinks
from lexmill.engine import Engine
from lexmill.operators import dictionary
from lexmill.session import local_session
from lexmill.sources import readers


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-u", metavar="FILE", help="unigram source")
    p.add_argument("-r", action="store_true", help="the unigram source is a plain list of terms")
    p.add_argument("-b", metavar="FILE", help="synonym source")
    p.add_argument("-t", metavar="FILE", help="thesaurus source")
    p.add_argument("-d", metavar="FOLDER", help="dictionaries to segment with")
    p.add_argument("-i", metavar="FILE", help="settings (INI)")
    p.add_argument("-o", metavar="FOLDER", default="dictionaries", help="where built dictionaries go")
    p.add_argument("-q", action="store_true", help="quiet: no time line")
    p.add_argument("-U", action="store_true", help="accepted; texts are UTF-8 or have a byte order mark")
    p.add_argument("text", nargs="?")
    a = p.parse_args(argv)
    spark = local_session()
    for kind, source in (("thesaurus", a.t), ("synonyms", a.b), ("unigram", a.u)):
        if source:
            built = dictionary.build_dict(spark, kind, source, a.o, a.r)
            if kind == "unigram" and (lost := dictionary.verify(built, readers.read_unigrams(spark, source, a.r)).count()):
                print(f"{lost} records are not found in the dictionary", file=sys.stderr)
                return 1
            print(f"{built.count()} entries in {a.o}/{kind}")
            return 0
    if not a.d or not a.text:
        p.print_usage(sys.stderr)
        return 2
    engine = Engine.load(spark, a.d)
    if a.i:
        engine = engine.with_settings(a.i)
    with contextlib.nullcontext() if a.q else sinks.timed():
        tokens = engine.segment_frame(readers.read_texts(spark, a.text))
        for row in sinks.marked_text(tokens, ["path"]).toLocalIterator():
            print(row.text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
