"""A registry of named tools over frames: each declares its parameters and their bounds, and is called by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from tessera.operators import events, signals, statistics


@dataclass(frozen=True)
class Parameter:
    """A parameter's type, default (``...``: required), bounds of a number or of a list's length, and allowed values."""

    kind: type
    default: Any = ...
    least: float | None = None
    most: float | None = None
    choices: tuple = ()

    def checked(self, name: str, value: Any) -> Any:
        if self.kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, self.kind) or isinstance(value, bool) and self.kind is not bool:
            raise ValueError(f"{name} must be of type {self.kind.__name__}")
        size = len(value) if self.kind in (list, str) else value
        if self.least is not None and size < self.least or self.most is not None and size > self.most:
            raise ValueError(f"{name} must be within {self.least} and {self.most}")
        if self.choices and value not in self.choices:
            raise ValueError(f"{name} must be one of {', '.join(map(str, self.choices))}")
        return value


@dataclass(frozen=True)
class Tool:
    run: Callable[..., DataFrame]
    parameters: dict[str, Parameter]
    description: str


class Registry:
    """Tools by name; a call checks its arguments against the declared ones before anything runs."""

    def __init__(self) -> None:
        self.tools: dict[str, Tool] = {}

    def register(self, name: str, description: str, **parameters: Parameter):
        def add(run):
            if name in self.tools:
                raise ValueError(f"tool {name!r} is registered twice")
            self.tools[name] = Tool(run, parameters, description)
            return run

        return add

    def schemas(self) -> list[dict]:
        """Each tool's name, description and parameters, in order of name."""
        return [
            {"name": n, "description": t.description, "parameters": {k: {"type": p.kind.__name__, "required": p.default is ..., "least": p.least, "most": p.most, "choices": list(p.choices)} for k, p in t.parameters.items()}}
            for n, t in sorted(self.tools.items())
        ]

    def call(self, name: str, rows: DataFrame, **arguments: Any) -> DataFrame:
        if name not in self.tools:
            raise ValueError(f"unknown tool {name!r}; known are {', '.join(sorted(self.tools))}")
        tool = self.tools[name]
        if odd := set(arguments) - set(tool.parameters):
            raise ValueError(f"{name} has no parameter {', '.join(sorted(odd))}")
        values = {}
        for key, p in tool.parameters.items():
            if key in arguments:
                values[key] = p.checked(key, arguments[key])
            elif p.default is ...:
                raise ValueError(f"{name} needs {key}")
            else:
                values[key] = p.default
        return tool.run(rows, **values)


TOOLS = Registry()
_KINDS = ("above", "below", "rising_above", "falling_below", "rate_of_change_above", "rate_of_change_below", "missing")


@TOOLS.register("read_window", "rows of a window, thinned", start_us=Parameter(int, None), end_us=Parameter(int, None), max_rows=Parameter(int, 100, 1, 500))
def _read_window(rows, start_us, end_us, max_rows):
    return events.read_window(rows, start_us, end_us, max_rows)


@TOOLS.register("get_signal_stats", "statistics of signals", signals=Parameter(list, ..., 1, 8))
def _signal_stats(rows, signals):
    return statistics.window_stats(rows.where(rows["signal"].isin(*signals)))


@TOOLS.register(
    "find_events", "events in which a condition holds", kind=Parameter(str, ..., choices=_KINDS), threshold=Parameter(float, 0.0), min_seconds=Parameter(float, 1.0, 0, 86_400),
    merge_seconds=Parameter(float, 5.0, 0, 86_400), max_events=Parameter(int, 20, 1, 100),
)
def _find_events(rows, kind, threshold, min_seconds, merge_seconds, max_events):
    return signals.first_events(events.find_events(rows, kind, threshold, min_seconds, merge_seconds), max_events)


@TOOLS.register("list_signals", "signals that fit a pattern", pattern=Parameter(str, "*", 1, 100), subsystem=Parameter(str, "all", choices=("engine", "abs", "all")))
def _list_signals(rows, pattern, subsystem):
    return signals.matching(rows.select("session", "signal").distinct(), pattern, subsystem)
