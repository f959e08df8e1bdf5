"""Licences that earlier rules did not find."""

from pyspark.sql import functions as F

from glossa.llm import licenses


def test_licence_signatures(spark):
    cases = {
        "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0",
        "SPDX-License-Identifier: LGPL-2.1": "lgpl-2.1", "SPDX-License-Identifier: AGPL-3.0": "agpl-3.0", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
        "SPDX-License-Identifier: EPL-2.0": "epl-2.0", "SPDX-License-Identifier: ISC": "isc", "SPDX-License-Identifier: MIT-0": "mit-0",
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2.0,mit", "SPDX-License-Identifier: Apache-2.0 OR MIT": "apache-2.0,mit",
        "Released under the MIT Licence.": "mit", "Apache Licence, v2.0": "apache-2.0", "the FreeBSD licence": "bsd-2-clause", "GPL v2": "gpl-2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "Neither the name of the University nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
        "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "gpl,gpl-2.0",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that": "isc",
        "This is free and unencumbered software released into the public domain.": "unlicense", "Wir gehen mit ihm.": "",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = [r.labels for r in licenses.scanned(rows).orderBy("doc_id").collect()]
    assert dict(zip(cases, got, strict=True)) == cases
    written = [*licenses.LICENCES, *licenses.SPDX_IDS, *licenses.TEXTS, *licenses.NOTICES]
    assert len({r[-1] for r in written}) >= 270  # patterns that differ, each written by hand


def _example(pattern):
    """A text that the pattern matches: optional parts left out, the first of alternatives, the least of a set."""
    import re._parser as parser

    def made(parsed):
        out = ""
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "NOT_LITERAL":
                out += "x"
            elif name == "IN":
                kind, value = arg[0]
                out += chr(value if str(kind) == "LITERAL" else value[0])
            elif name == "MAX_REPEAT":
                out += made(arg[2]) * arg[0]
            elif name == "SUBPATTERN":
                out += made(arg[3])
            elif name == "BRANCH":
                out += made(arg[1][0])
        return out

    return made(parser.parse(pattern))


def test_every_rule_finds_its_example(spark):
    """Each hand-written pattern passes its gate: its label, or that of an equal interval's earlier rule, is found."""
    rows = [(f"see {_example(core)} x", label) for label, _, core in (*licenses.LICENCES, *licenses.TEXTS, *licenses.NOTICES)]
    rows += [(f"SPDX-License-Identifier: {_example(core)} x", label) for label, core in licenses.SPDX_IDS]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    lost = [(*rows[r.doc_id], r.labels) for r in licenses.scanned(df).collect() if rows[r.doc_id][1] not in r.labels.split(",")]
    assert not lost, lost


def test_base_columns_by_plain_code(spark):
    import random
    import re

    rng = random.Random(5)
    pool = ["cc", "by", "CC", "By", "general", "public", "LICENSE", "all", "rights", "reserved", "x9", "é", "¡", "mit", "license"]
    texts = ["", None, " ", "cc by", "cc by cc by", "cc by" * 3] + ["".join(rng.choice(pool) + rng.choice([" ", "-", ", ", "\n", "", "_"]) for _ in range(rng.randint(1, 60))) for _ in range(300)] + ["cc by general public license " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("words", F.lit(2))
    got = {r.doc_id: r for r in licenses.scanned(df.where("doc_id is not null")).collect()}
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(j, label) for p, label in phrases.items() for j in range(len(ws)) if ws[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(ws), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.base, r.words) == (1, 2)
