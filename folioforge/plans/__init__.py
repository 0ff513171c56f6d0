"""Named queries over the test tables, with the SQL that gives the same rows; one module per area."""

MODULES = ["references", "text", "search", "chat", "library"]


def sql_text(value: str) -> str:
    """A string as an SQL literal, control characters by number."""
    parts, plain = [], ""
    for c in value:
        if ord(c) < 32 or 0x7F <= ord(c) <= 0xA0 or ord(c) in (0x1680, 0x3000, 0xFEFF) or 0x2000 <= ord(c) <= 0x205F:
            if plain:
                parts.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            parts.append(f"chr({ord(c)})")
        else:
            plain += c
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"
