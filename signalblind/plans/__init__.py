"""Registered queries, by area."""


def load():
    from . import queries_detectors, queries_frames, queries_runs, queries_stats, queries_streams, registry  # noqa: F401

    return registry
