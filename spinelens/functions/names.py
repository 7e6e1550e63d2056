"""File names and class names."""

from __future__ import annotations

from spinelens import vocab

_CLASS_LIST = "array(" + ", ".join(f"'{c}'" for c in vocab.MERGED_CLASSES) + ")"


def class_name(class_id: str = "class_id", default_prefix: str | None = "Class_",
               n_classes: int = len(vocab.VERTEBRA_CLASSES)) -> str:
    """Label of a class id; an unknown id becomes ``<prefix><id>``, or NULL without a prefix."""
    known = f"{class_id} >= 0 AND {class_id} < {n_classes}"
    other = "NULL" if default_prefix is None else f"concat('{default_prefix}', {class_id})"
    return f"CASE WHEN {known} THEN get({_CLASS_LIST}, {class_id}) ELSE {other} END"


def class_id(label: str = "label") -> str:
    """Class id of a vertebra label, NULL for a label outside the class map."""
    names = ", ".join(f"'{c}'" for c in vocab.VERTEBRA_CLASSES)
    return f"nullif(array_position(array({names}), {label}), 0) - 1"


def stem(file_name: str) -> str:
    """Name without its last extension."""
    return f"regexp_replace({file_name}, '(?<=.)[.][^.]*$', '')"


def extension(file_name: str) -> str:
    """Last extension, case kept; empty when there is none."""
    return f"regexp_extract({file_name}, '[.]([^.]*)$', 1)"


def last_part(path: str) -> str:
    return f"element_at(split({path}, '/'), -1)"


def parent_name(path: str) -> str:
    """Name of the directory that holds a file."""
    return f"try_element_at(split({path}, '/'), -2)"


def extension_rank(ext: str = "ext") -> str:
    """Position of an extension in the build order."""
    names = ", ".join(f"'{e}'" for e in vocab.BUILD_EXTENSIONS)
    return f"array_position(array({names}), {ext})"
