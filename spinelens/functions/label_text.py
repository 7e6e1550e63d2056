"""Label lines: ``class cx cy w h`` followed by ``x y v`` per keypoint."""

from __future__ import annotations


def _six(value: str) -> str:
    """``%.6f`` of a number. A cast to a decimal rounds the shortest decimal form half up, too, in a fraction of the time."""
    return (f"CASE WHEN {value} > 0 AND {value} < 1e9 THEN CAST(CAST({value} AS DECIMAL(16, 6)) AS STRING)"
            f" ELSE format_string('%.6f', {value}) END")


def _whole(value: str) -> str:
    return f"coalesce(CAST({value} AS STRING), 'null')"


def format_line(class_id: str = "class_id", keypoints: str | None = "keypoints") -> str:
    """Text of a label row: six decimals, visibility as an integer."""
    head = f"concat_ws(' ', {_whole(class_id)}, {', '.join(map(_six, ('cx', 'cy', 'w', 'h')))})"
    if keypoints is None:
        return head
    tail = f"transform({keypoints}, k -> concat(' ', {_six('k.x')}, ' ', {_six('k.y')}, ' ', {_whole('k.v')}))"
    return f"concat({head}, array_join({tail}, ''))"


def fields(line: str = "line") -> str:
    """Whitespace-separated fields of a line; a blank line has none.

    Tabs and the like become blanks first: splitting at one character needs no regular expression.
    """
    text = line
    for blank in ("\\t", "\\r", "\\n", "\\u000B", "\\u000C"):
        text = f"replace({text}, '{blank}', ' ')"
    return f"array_remove(split({text}, ' '), '')"


def keypoint_fields(parts: str = "fields") -> str:
    """All complete ``x y v`` triples after the fifth field."""
    last = f"greatest(CAST((size({parts}) - 5) DIV 3 AS INT) - 1, 0)"
    return (
        f"transform(filter(sequence(0, {last}), k -> size({parts}) >= 8 + 3 * k), k -> named_struct("
        f"'x', try_cast(get({parts}, 5 + 3 * k) AS DOUBLE),"
        f" 'y', try_cast(get({parts}, 6 + 3 * k) AS DOUBLE),"
        f" 'v', try_cast(get({parts}, 7 + 3 * k) AS INT)))"
    )
