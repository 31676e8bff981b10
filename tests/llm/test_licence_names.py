"""Licences that are nearly one another: the right one or none, never another's."""

import pytest

from loomgraph.llm import licenses

AGPL = "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
NEAR = {
    "SPDX-License-Identifier: Proprietary": None,
    "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0",
    "// SPDX-License-Identifier: BSL-1.0": "BSL-1.0",
    "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
    "SPDX-License-Identifier: LGPL-2.0-only": None,
    "/* SPDX-License-Identifier: GPL-2.0+ */": "GPL-2.0",
    "# spdx-license-identifier: (mit OR Apache-2.0)": "(mit OR Apache-2.0)",
    "SPDX-License-Identifier: MIT AND Proprietary": None,
    "SPDX-License-Identifier: Proprietary\nReleased under the MIT License.": None,
    "SPDX-License-Identifier:": None,
    "Licensed under the Eclipse Public License, Version 2.0.": "EPL-2.0",
    "Licensed under the Eclipse Public License, Version 1.0.": None,
    "Licensed under the Business Source License, Version 1.1.": None,
    "Creative Commons Attribution-ShareAlike 4.0 International Public License": "CC-BY-SA-4.0",
    "Creative Commons Attribution-NoDerivatives 4.0 International Public License": None,
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License": None,
    "Creative Commons Attribution 3.0 Unported License": None,
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY-ND 4.0.": None,
    "This program is free software: you can redistribute it and/or modify it " + AGPL: "AGPL-3.0",
    "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "AGPL-3.0",
    "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": "LGPL-2.1",
    "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "GPL-2.0",
    "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0",
    "GNU Free Documentation License\nVersion 1.3, 3 November 2008": None,
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": None,
    "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License.": None,
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the Apache License, Version 1.1.": None,
    "Released under the MIT License.": "MIT",
    "Released under the MIT License or the Apache License, Version 2.0.": None,
    "Proprietary. Not released under the MIT License.": None,
}


@pytest.fixture(scope="module")
def found(spark):
    # Beside texts of the given tables, as word weights come from all files.
    own = spark.createDataFrame([(10**6 + k, f"x/{k}.txt", text) for k, text in enumerate(NEAR)], "doc_id long, path string, text string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "concat('d/', doc_id) AS path", "text")
    return {r.doc_id - 10**6: r.declared for r in licenses.scan(own.union(docs)).where("doc_id >= 1000000").collect()}


@pytest.mark.parametrize("k", range(len(NEAR)), ids=lambda k: list(NEAR)[k][:40])
def test_near_licences(found, k):
    assert found[k] == list(NEAR.values())[k]
