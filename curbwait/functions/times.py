"""Time arithmetic as SQL expressions."""


def epoch_seconds(moment: str) -> str:
    """Whole seconds since 1970, sub-seconds floored.

    The cast through timestamp admits timestamps without time zone, which have
    no direct cast to a number.
    """
    return f"cast(cast({moment} as timestamp) as bigint)"


def whole_hours(start: str, stop: str) -> str:
    """Hours from start to stop in epoch seconds, rounded toward minus infinity."""
    return f"cast(floor(({stop} - {start}) / 3600) as int)"


def whole_minutes(seconds: str) -> str:
    """Seconds to minutes, truncated toward zero."""
    return f"({seconds} div 60)"
