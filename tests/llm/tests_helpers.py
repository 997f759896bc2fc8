from test_near_duplicates import brute as brute_groups  # noqa: F401
