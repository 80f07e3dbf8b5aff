"""Data folders of the tests (a module of its own: two folders have a conftest)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
