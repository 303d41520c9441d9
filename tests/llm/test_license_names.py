"""Identifiers, permissiveness and expressions that break off."""

import pytest

from threadlens.llm import licenses as L


@pytest.mark.parametrize(
    ("text", "free"),
    [
        ("Artistic-1.0-Perl OR GPL-1.0-or-later", False), ("BSD-3-Clause-LBNL", True), ("CC-BY-NC-SA-2.5", False), ("BSL-1.0", True), ("PostgreSQL", True), ("NCSA", True), ("UPL-1.0", True), ("PSF-2.0", True), ("X11", True),
        ("Unicode-3.0", True), ("BlueOak-1.0.0", True), ("MIT AND GPL-2.0-only", False), ("MIT OR GPL-2.0-only", True), ("(MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception", True), ("CC-BY-4.0", True), ("CC-BY-ND-4.0", False),
        ("MPL-2.0-no-copyleft-exception", False), ("MIT and (see the file)", True), ("GPL-2.0+", False), ("LicenseRef-mine", False),
    ],
)
def test_permissive(text, free):
    assert L.evaluate(text)[1] is free


@pytest.mark.parametrize(("text", "names", "free"), [("MIT AND (BSD-3-Clause", ["mit"], False), ("MIT OR (Apache-2.0 AND (ISC)", ["mit"], True), ("MIT AND (see", ["mit"], True)])
def test_expressions_that_break_off(text, names, free):
    assert L.evaluate(text) == (names, free)


@pytest.mark.parametrize("text", ["(MIT", "none of these", ""])
def test_what_is_no_expression(text):
    with pytest.raises(ValueError):
        L.evaluate(text)
