"""License texts without a name, later versions, exceptions and denials."""

import time

import pytest

from annulus.llm import license_rules

CASES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software')", {"mit"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", {"bsd"}),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", {"bsd"}),
    ("Copyright (c) 1999, 2001 Some Body. All rights reserved.", {"all-rights-reserved", "copyright"}),
    ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0-or-later"}),
    ("SPDX-License-Identifier: GPL-3.0-only", {"gpl-3.0-only"}),
    ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", {"gpl", "gpl-2.0-or-later"}),
    ("it is not licensed under the terms of the BSD License", set()),
    ("not under the MIT license", {"mit"}),  # a base phrase stays
    ("GPL v2 with Classpath exception", {"gpl-2.0", "classpath-exception"}),
    ("https://creativecommons.org/licenses/by-sa/4.0/", {"cc-by-sa-4.0"}),
    ("\u212Ait L\u0130CENSE", set()),  # only A-Z are lower-cased
    ("nothing of the kind", set()),
]


@pytest.mark.parametrize("text,labels", CASES)
def test_labels(spark, text, labels):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = license_rules.digest(license_rules.scan(frame)).first()
    assert set(filter(None, row.labels.split(","))) == labels


def test_a_long_list_of_licenses_takes_time_in_proportion(spark):
    def seconds(n):
        frame = spark.createDataFrame([(1, "the MIT license and the Apache License, version 2.0; " * n)], "doc_id long, text string")
        began = time.perf_counter()
        row = license_rules.digest(license_rules.scan(frame)).first()
        assert row.n_base == 2 * n and row.first_word == 1 and row.last_word == 10 * n - 5
        return time.perf_counter() - began

    seconds(10)
    few, many = seconds(2_000), seconds(16_000)
    assert many < 16 * few + 5
