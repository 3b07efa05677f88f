"""A small table of queries with the SQL each one is checked against."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, oracle: str | None = None):
        def register(function):
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = function
            if oracle is not None:
                self.oracles[name] = oracle
            return function

        return register
