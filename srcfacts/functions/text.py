"""Scalar functions on code, log and path text: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never name a declaration.
KEYWORDS = (
    "define undef ifdef ifndef main include "
    "if else switch case default for do while break goto continue "
    "bool true false auto register static extern typedef "
    "void char short int long float double signed unsigned struct enum union "
    "const volatile sizeof return asm NULL"
).split()


def identifiers(code: Column, fuse_lines: bool = False) -> Column:
    """Distinct identifiers without keywords, in order of appearance. Lines are apart; ``fuse_lines`` joins words across them."""
    flat = F.replace(code, F.lit("\n"), F.lit("" if fuse_lines else " "))
    found = F.array_distinct(F.regexp_extract_all(flat, F.lit(r"\b[_a-zA-Z][_a-zA-Z0-9]*\b"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, KEYWORDS)))


def span(text: Column, begin: Column, end: Column) -> Column:
    """Text from line and column to line and column (structs, 1-based), both ends included."""
    lines = F.slice(F.split(text, "\n", -1), begin["line"], F.greatest(end["line"] - begin["line"] + 1, F.lit(0)))
    whole = F.array_join(lines, "\n")
    last = F.length(F.element_at(lines, -1))
    cut = F.greatest(last - end["col"], F.lit(0))
    return F.when(F.size(lines) > 0, F.substring(whole, begin["col"], F.length(whole) - cut - begin["col"] + 1)).otherwise(F.lit(""))


def span_to_semicolon(text: Column, begin: Column, end: Column) -> Column:
    """``span``, on to the next semicolon behind it where there is one."""
    lines = F.split(text, "\n", -1)
    rest = F.concat(F.substr(F.element_at(lines, end["line"]), end["col"] + 1), F.lit("\n"), F.array_join(F.slice(lines, end["line"] + 1, F.size(lines)), "\n"))
    return F.concat(span(text, begin, end), F.when(rest.contains(";"), F.concat(F.substring_index(rest, ";", 1), F.lit(";"))).otherwise(F.lit("")))


def function_declaration(code: Column) -> Column:
    """Head of a function definition as a declaration; ``inline`` goes, and so do old-style parameter types."""
    head = trimmed(F.substring_index(code, "{", 1))
    old_style = F.regexp_extract(head, r"(?s)^(.*?\))[^()]*;\s*$", 1)
    head = F.when(old_style != "", old_style).otherwise(head)
    return F.concat(trimmed(F.regexp_replace(head, r"\b(__)?inline(__)?\b\s*", "")), F.lit(";"))


def record_declaration(code: Column) -> Column:
    """``struct a {...};`` to ``struct a;``."""
    return F.concat(trimmed(F.substring_index(code, "{", 1)), F.lit(";"))


def typedef_declaration(code: Column) -> Column:
    """A typedef with its record body cut out."""
    return F.regexp_replace(code, r"(?s)\s*\{.*\}\s*", " ")


def include_target(line: Column) -> Column:
    """Target of an include directive, else null."""
    found = F.regexp_extract(line, r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', 1)
    return F.when(found != "", found)


def include_is_system(line: Column) -> Column:
    return F.regexp_extract(line, r"^\s*#\s*include\s*(<)", 1) == "<"


def assertion_condition(line: Column) -> Column:
    """Condition of an assert line with ``output_int_`` before its names and NULL as 0; null if there is none."""
    inside = F.regexp_extract(line, r"assert\s*\((.*)\)\s*;", 1)
    named = F.regexp_replace(F.regexp_replace(inside, r"\bNULL\b", "0"), r"\b([A-Za-z_]\w*)\b", "output_int_$1")
    return F.when(inside != "", named)


def split_blank(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def split_char(text: Column, char: str) -> Column:
    """Parts between ``char``; a last empty part is left out, a first one isn't."""
    return F.split(F.regexp_replace(text, _quoted(char) + "$", ""), _quoted(char), -1)


def split_any(text: Column, chars: str) -> Column:
    return F.filter(F.split(text, "[" + "".join("\\" + c for c in chars) + "]", -1), lambda x: x != "")


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def last_component(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def relative_path(path: Column, root: Column | str) -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(path)


def has_path_suffix(path: Column, suffix: Column) -> Column:
    """Suffix by whole components."""
    bare = F.regexp_replace(suffix, "^/+", "")
    return (F.regexp_replace(path, "^/+", "") == bare) | F.endswith(path, F.concat(F.lit("/"), bare))


def path_without_suffix(path: Column, suffix: Column) -> Column:
    """What stands before a path suffix; null if it is none."""
    size = F.length(path) - F.length(F.regexp_replace(suffix, "^/+", "")) - 1
    return F.when(has_path_suffix(path, suffix), F.substring(path, F.lit(1), F.greatest(size, F.lit(0))))


def is_number(text: Column) -> Column:
    """Digits and minus signs only, at least one."""
    return F.coalesce(text.rlike(r"^[-0-9]+$"), F.lit(False))


def is_address(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^0x[0-9a-fA-F]+$"), F.lit(False))


def address_value(text: Column) -> Column:
    """Hex address as a number; ``(nil)`` is 0; else null."""
    value = F.conv(F.substring(text, 3, 18), 16, 10).cast("decimal(20,0)")
    return F.when(is_address(text), value).when(text == "(nil)", F.lit(0).cast("decimal(20,0)"))


def coverage_percent(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9.]+)\s*%", 1).try_cast("double")


def coverage_of(text: Column) -> Column:
    return F.regexp_extract(text, r"of\s+([0-9]+)", 1).try_cast("long")


def seconds(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9.]+)\s*seconds", 1).try_cast("double")


def escape_name(name: Column) -> Column:
    return F.translate(name, "[]", "__")


def repository_id(url: Column) -> Column:
    """``owner--name`` of a repository's address."""
    return F.regexp_replace(F.regexp_extract(url, r"([^/:]+/[^/]+?)(\.git)?/*$", 1), "/", "--")


def exit_class(code: Column) -> Column:
    return F.when(code == 0, "success").when(code == 124, "timeout").otherwise("crash")


COMPARISON = r"(<=|>=|==|!=|<|>|=)"


def condition_parts(condition: Column) -> Column:
    """struct(lhs, op, rhs) of a condition at its first comparison; null parts where there is none."""
    part = lambda i: F.trim(F.regexp_extract(condition, r"^(.*?)" + COMPARISON + r"(.*)$", i))
    some = condition.rlike(COMPARISON)
    return F.struct(F.when(some, part(1)).alias("lhs"), F.when(some, part(2)).alias("op"), F.when(some, part(3)).alias("rhs"))


def condition_tokens(side: Column) -> Column:
    return F.filter(F.split(side, r"[\s+*/()-]+"), lambda x: x != "")


def compile_message(line: Column) -> Column:
    """A compiler's error line, cut at the first quote and up to "error"."""
    return F.regexp_replace(F.regexp_replace(line, r"'.*", ""), r"^.*error", "")


def formula(slope: Column, intercept: Column, x: Column) -> Column:
    """``k * x + b`` without a factor of 1 and without an added 0."""
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0+$", "")
    product = F.when(slope == 1, x).otherwise(F.concat(number(slope), F.lit(" * "), x))
    return F.when(intercept == 0, product).otherwise(F.concat(product, F.lit(" + "), number(intercept)))


def marked_tokens(dump: Column, mark: str = "*") -> Column:
    """Leaves of a tree dump ``(kind *token)`` that carry the mark."""
    return F.regexp_count(dump, F.lit("\\Q" + mark + "\\E[^()\\s]+"))


def xml_names(xml: Column) -> Column:
    return F.xpath(xml, F.lit("//name/text()"))


def xml_calls(xml: Column) -> Column:
    return F.xpath(xml, F.lit("//call/name/text()"))


def xml_types(xml: Column) -> Column:
    return F.xpath(xml, F.lit("//decl/type/name/text()"))


def xml_declared(xml: Column) -> Column:
    return F.xpath(xml, F.lit("//decl/name/text()"))


def xml_text(xml: Column) -> Column:
    """Text without comments."""
    return F.array_join(F.xpath(xml, F.lit("//text()[not(ancestor::comment)]")), "")


def option_flags(spec: Column) -> Column:
    """Options of ``ab:c`` without a value."""
    return F.transform(F.regexp_extract_all(spec, F.lit(r"([A-Za-z0-9])(?!:)"), F.lit(1)), lambda x: x)


def option_values(spec: Column) -> Column:
    """Options of ``ab:c`` with a value."""
    return F.regexp_extract_all(spec, F.lit(r"([A-Za-z0-9]):"), F.lit(1))


# Bits of a type text.
PRIMITIVE, REFERENCE, ARRAY, POINTER = 1, 2, 4, 8


def type_bits(text: Column) -> Column:
    primitive = text.rlike(r"\b(int|char|short|long|float|double|bool|size_t|unsigned|signed)\b")
    bit = lambda c, n: F.when(c, n).otherwise(0)
    return bit(primitive, PRIMITIVE).bitwiseOR(bit(text.contains("&"), REFERENCE)).bitwiseOR(bit(text.contains("["), ARRAY)).bitwiseOR(bit(text.contains("*"), POINTER))


def is_string_type(text: Column) -> Column:
    return text.rlike(r"\bchar\s*(\*|\[)")


def is_buffer_type(text: Column) -> Column:
    return text.contains("[") & text.rlike(r"\bchar\b")


def type_with_indirection(text: Column) -> Column:
    """struct(name, stars): a type text without its stars, qualifiers and ``struct``."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"\*", " "), r"\b(const|volatile|struct|enum|union)\b\s*", ""))
    return F.struct(bare.alias("name"), F.regexp_count(text, F.lit(r"\*")).alias("stars"))
