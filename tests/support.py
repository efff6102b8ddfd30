"""Constants the tests share; no test module imports a ``conftest``, whose name two folders have."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
