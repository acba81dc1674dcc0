"""Plan shapes that several operators share: row identity and ordered prefix sums."""
