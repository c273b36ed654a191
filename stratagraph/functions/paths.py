"""What a path or a dotted name says of a file. The definitions of a test differ on purpose; each belongs to its own question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders of vendored code and of tests, parts of names that mark tests.
VENDORED = ("_vendor", "vendored", "third_party", "site-packages", "module_utils")
TEST_DIRS = ("tests", "test")
TEST_PARTS = ("tests", "test", "testing", "_test", "_tests")
TEST_PREFIXES = ("test-", "test_", "tests-", "_test")


def _any_of(parts: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))


def is_vendored(path: Column) -> Column:
    """A segment of the path names vendored code."""
    return _any_of(F.split(path, "/"), VENDORED)


def is_test_code(path: Column) -> Column:
    """Of duplicates and coupling: conftest.py, test_*, *_test.py, or a segment tests or test."""
    name = F.element_at(F.split(path, "/"), -1)
    return (name == "conftest.py") | name.endswith("_test.py") | name.startswith("test_") | _any_of(F.split(path, "/"), TEST_DIRS)


def is_run_test(path: Column) -> Column:
    """Of affected tests: test_*.py, *_test.py, or a segment tests."""
    return path.rlike(r"(^|/)(test_[^/]*|[^/]*_test)\.py$") | _any_of(F.split(path, "/"), ("tests",))


def is_conventional_test(path: Column) -> Column:
    """Of the scan, which has no filter yet: test_*, *_test.py, or a segment tests."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.startswith("test_") | name.endswith("_test.py") | _any_of(F.split(path, "/"), ("tests",))


def is_test_module(qualname: Column) -> Column:
    """Of censuses, by dotted name: a part that means tests, a folder that begins like one, or a last part test_*, *_test, conftest."""
    parts = F.split(qualname, r"\.")
    last, folders = F.element_at(parts, -1), F.slice(parts, F.lit(1), F.size(parts) - 1)
    begins = F.exists(folders, lambda p: p.rlike("^(" + "|".join(TEST_PREFIXES) + ")"))
    return _any_of(parts, TEST_PARTS) | begins | last.startswith("test_") | last.endswith("_test") | (last == "conftest")
