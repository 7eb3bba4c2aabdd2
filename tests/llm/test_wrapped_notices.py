from tidemark.llm import licences

GPL3 = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."
BSD = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:"


def test_notices_wrapped_over_lines(spark):
    plain = "the weather was fine\nand we went for a walk\nunder the trees of the park"
    rows = [(1, GPL3), (2, BSD), (3, f"{plain}\n{GPL3}\n{plain}"), (4, f"{GPL3}\n *\n{BSD}\n\n{plain}"), (5, plain), (6, BSD.replace("\n", "\n\n"))]
    got = {r["doc_id"]: (r["licences"], r["n_notices"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("GPL-3.0", 1), 2: ("BSD", 1), 3: ("GPL-3.0", 1), 4: ("BSD,GPL-3.0", 2), 5: ("", 0), 6: ("", 0)}


GPL2 = "/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version. */"
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."


def test_versions_and_variants(spark):
    """The template that is matched best names the version; an empty table, nulls and clashing names do no harm."""
    lines = {1: GPL2, 2: GPL2.replace("\n * ", " "), 3: GPL3.replace("\n * ", " "), 4: ISC, 5: "Licensed under CC BY-NC-SA 4.0.", 6: "Licensed under CC BY-ND 4.0.", 7: "SPDX-License-Identifier: GPL-2.0-or-later", 8: None, 9: ""}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in lines.items()], "doc_id long, text string, n_notices int, _line string")
    got = {r["doc_id"]: r["licences"] for r in licences.scan(df).collect()}
    assert got == {1: "GPL-2.0", 2: "GPL-2.0", 3: "GPL-3.0", 4: "ISC", 5: "CC-BY-NC-SA", 6: "CC-BY-ND", 7: "GPL-2.0", 8: "", 9: ""}
    assert licences.scan(df.limit(0)).count() == 0
