"""Profiles: the configuration of a run, its inheritance, validation and edits.

Profiles live on the driver and are compiled to Column expressions
(``quillmatch.functions.rules``); they are never joined.
"""

from __future__ import annotations

import copy
import re
import shutil
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

# The file format, that is the names of conditions, strategies and fields here and in the classes
# below, and the fields' defaults.
CONDITIONS = ("contains", "starts_with", "regex", "domain_in", "multi_line", "max_length", "min_length", "subject_is", "fallback")
STRATEGIES = ("largest_bold_text", "top_left_block")


def _checked(pattern: str, what: str) -> str:
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"{what} {pattern!r} is not a regular expression: {e}") from e
    return pattern


@dataclass(frozen=True)
class Condition:
    contains: str | None = None
    starts_with: str | None = None
    regex: str | None = None
    domain_in: str | None = None
    multi_line: bool | None = None
    max_length: int | None = None
    min_length: int | None = None
    subject_is: str | None = None
    fallback: bool | None = None

    def __post_init__(self) -> None:
        if self.regex is not None:
            _checked(self.regex, "rule regex")


@dataclass(frozen=True)
class Rule:
    conditions: Condition
    category: str


@dataclass(frozen=True)
class FormNameRules:
    strategy: str = "largest_bold_text"
    min_font_size: float = 12.0
    exclude_patterns: list[str] = field(default_factory=list)
    top_region_fraction: float | None = None
    label_prefix: str | None = None

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown form name strategy {self.strategy!r}")


@dataclass(frozen=True)
class VisitRule:
    regex: str
    value: str

    def __post_init__(self) -> None:
        _checked(self.regex, "visit regex")


@dataclass(frozen=True)
class AnchorText:
    radius_px: float = 100.0
    prefer_direction: list[str] = field(default_factory=lambda: ["left", "above"])
    left_column_tolerance_px: float = 50.0


@dataclass(frozen=True)
class AnnotationFilter:
    include_types: list[str] = field(default_factory=lambda: ["FreeText"])
    exclude_empty: bool = True
    min_content_length: int = 1


@dataclass(frozen=True)
class Matching:
    exact_threshold: float = 1.0
    fuzzy_same_form_threshold: float = 0.80
    fuzzy_cross_form_threshold: float = 0.90
    position_fallback_confidence: float = 0.50
    visit_boost: float = 5.0


@dataclass(frozen=True)
class StyleDefaults:
    font: str = "Arial"
    font_size: float = 10.0
    domain_label_font_size: float = 14.0
    text_color: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    border_color: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    fill_color: list[float] | None = None
    use_source_style: bool = True


@dataclass(frozen=True)
class Profile:
    meta: dict[str, Any]
    domain_codes: list[str]
    classification_rules: list[Rule]
    form_name_rules: FormNameRules = FormNameRules()
    visit_rules: list[VisitRule] = field(default_factory=list)
    anchor_text_config: AnchorText = AnchorText()
    annotation_filter: AnnotationFilter = AnnotationFilter()
    matching_config: Matching = Matching()
    style_defaults: StyleDefaults = StyleDefaults()


def _built(kind: type, raw: dict | None) -> Any:
    known = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in (raw or {}).items() if k in known})


def profile_of(raw: dict) -> Profile:
    """A validated profile. Unknown keys of a rule's conditions are errors, other unknown keys are ignored."""
    for part in ("meta", "domain_codes", "classification_rules"):
        if part not in raw:
            raise ValueError(f"the profile has no {part}")
    if not (raw["meta"] or {}).get("name"):
        raise ValueError("the profile has no name")
    for part in ("domain_codes", "classification_rules"):
        if not isinstance(raw[part], list):
            raise ValueError(f"{part} is no list")
    rules = []
    for r in raw["classification_rules"]:
        if extra := set(r.get("conditions") or {}) - set(CONDITIONS):
            raise ValueError(f"unknown conditions {sorted(extra)}")
        rules.append(Rule(Condition(**(r.get("conditions") or {})), r["category"]))
    visits = []
    for v in raw.get("visit_rules") or []:
        if "value" not in v:
            raise ValueError("a visit rule has no value")
        visits.append(VisitRule(v["regex"], v["value"]))
    meta = {"version": "1.0", "description": "", "author": "", "parent": None} | raw["meta"]
    return Profile(
        meta=meta,
        domain_codes=list(raw["domain_codes"]),
        classification_rules=rules,
        form_name_rules=_built(FormNameRules, raw.get("form_name_rules")),
        visit_rules=visits,
        anchor_text_config=_built(AnchorText, raw.get("anchor_text_config")),
        annotation_filter=_built(AnnotationFilter, raw.get("annotation_filter")),
        matching_config=_built(Matching, raw.get("matching_config")),
        style_defaults=_built(StyleDefaults, raw.get("style_defaults")),
    )


def merged(base: Any, over: Any) -> Any:
    """``over`` laid over ``base``: mappings recursively, a mapping with _append or _replace over a list as it says, all else replaced."""
    if isinstance(base, dict) and isinstance(over, dict):
        out = copy.deepcopy(base)
        for k, v in over.items():
            out[k] = merged(base[k], v) if k in base else copy.deepcopy(v)
        return out
    if isinstance(base, list) and isinstance(over, dict):
        if "_append" in over:
            return copy.deepcopy(base) + copy.deepcopy(over["_append"])
        if "_replace" in over:
            return copy.deepcopy(over["_replace"])
    return copy.deepcopy(over)


def read_raw(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def inherited(raw: dict, folder: str | Path, seen: tuple[str, ...] = ()) -> dict:
    """``raw`` over its parents, which are files of ``folder``."""
    parent = (raw.get("meta") or {}).get("parent")
    if not parent:
        return raw
    if parent in seen:
        raise ValueError(f"profiles inherit in a circle: {' > '.join((*seen, parent))}")
    path = Path(folder) / f"{parent}.yaml"
    if not path.exists():
        raise FileNotFoundError(f"parent profile {path}")
    return merged(inherited(read_raw(path), folder, (*seen, parent)), raw)


def load_profile(path: str | Path, folder: str | Path | None = None) -> Profile:
    path = Path(path)
    return profile_of(inherited(read_raw(path), folder or path.parent, (path.stem,)))


def validate(raw: dict, folder: str | Path) -> Profile:
    return profile_of(inherited(raw, folder))


def list_profiles(folder: str | Path) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.yaml"))


# ---------------------------------------------------------------- edits


def list_delta(parent: list | None, values: list) -> Any:
    """How ``values`` are stored over a parent's list: None if equal, _append if they only go on, else _replace."""
    if parent is None:
        return list(values)
    if values == parent:
        return None
    if values[: len(parent)] == parent:
        return {"_append": values[len(parent) :]}
    return {"_replace": list(values)}


LISTS = ("domain_codes", "classification_rules", "visit_rules")


def changed(raw: dict, before: dict, after: dict, folder: str | Path) -> dict:
    """``raw`` with what changed from ``before`` to ``after`` (both whole profiles); keys that the editor doesn't own stay."""
    out = copy.deepcopy(raw)
    parent_name = (raw.get("meta") or {}).get("parent")
    parent = inherited(read_raw(Path(folder) / f"{parent_name}.yaml"), folder) if parent_name else {}
    for key, value in after.items():
        if value == before.get(key):
            continue
        if key in LISTS:
            delta = list_delta(parent.get(key) if parent_name else None, value)
            if delta is None:
                out.pop(key, None)
            else:
                out[key] = delta
        elif isinstance(value, dict):
            own = dict(out.get(key) or {})
            own.update({k: v for k, v in value.items() if v != (before.get(key) or {}).get(k)})
            out[key] = own
        else:
            out[key] = value
    return without_stale(out)


def without_stale(raw: dict) -> dict:
    out = copy.deepcopy(raw)
    (out.get("anchor_text_config") or {}).pop("exclude_patterns", None)
    return out


def safe_name(name: str) -> str:
    """A file name of a profile's name: nothing in it leads out of the folder."""
    if not re.fullmatch(r"[\w\-. ]+", name) or name.startswith("."):
        raise ValueError(f"{name!r} can't name a profile")
    return name


def save_profile(folder: str | Path, name: str, draft: dict) -> Profile:
    """Validates ``draft`` (a whole profile), stores what it changes, and loads the result."""
    import yaml

    path = Path(folder) / f"{safe_name(name)}.yaml"
    raw = read_raw(path)
    validate(draft, folder)
    out = changed(raw, inherited(raw, folder), draft, folder)
    validate(out, folder)
    path.write_text(yaml.safe_dump(out, sort_keys=False, allow_unicode=True), encoding="utf-8")
    return load_profile(path)


def duplicate_profile(folder: str | Path, name: str) -> str:
    folder, k = Path(folder), 1
    while (folder / f"{name}_copy{k if k > 1 else ''}.yaml").exists():
        k += 1
    new = f"{name}_copy{k if k > 1 else ''}"
    shutil.copyfile(folder / f"{safe_name(name)}.yaml", folder / f"{new}.yaml")
    return new


def import_profile(folder: str | Path, text: str) -> str:
    import yaml

    raw = yaml.safe_load(text) or {}
    validate(raw, folder)
    name = safe_name(raw["meta"]["name"])
    (Path(folder) / f"{name}.yaml").write_text(text, encoding="utf-8")
    return name


def with_domain(codes: list[str], code: str) -> list[str]:
    return sorted({*codes, code.strip().upper()} - {""})


def without_domain(codes: list[str], code: str) -> list[str]:
    return sorted(set(codes) - {code.strip().upper()})


def moved_up(rules: list, k: int) -> list:
    out = list(rules)
    if 0 < k < len(out):
        out[k - 1], out[k] = out[k], out[k - 1]
    return out


def with_rule(rules: list, rule: object, k: int | None = None) -> list:
    """With a rule added at the end, or in the place of rule ``k``."""
    return [*rules, rule] if k is None else [rule if i == k else r for i, r in enumerate(rules)]


def without_rule(rules: list, k: int) -> list:
    return [r for i, r in enumerate(rules) if i != k]


def condition_summary(condition: dict) -> str:
    """The first three conditions that are set."""
    return ", ".join(f"{k}={v}" for k, v in [(k, v) for k, v in condition.items() if v is not None][:3]) or "(none)"


def as_dict(profile: Profile) -> dict:
    return asdict(profile)


def standard_profile() -> Profile:
    """The profile for annotations by the common study data model."""
    # Domain codes, rules in their order, form name exclusions and visits.
    return profile_of(
        {
            "meta": {"name": "standard"},
            "domain_codes": ["DM", "IE", "MH", "CM", "AE", "VS", "EG", "PE", "QS", "DS", "DA", "EX", "SC", "LB", "SV", "SE", "CO", "FA", "TU", "TR", "RS"],
            "classification_rules": [
                {"conditions": {"max_length": 0}, "category": "_exclude"},
                {"conditions": {"subject_is": "Sticky Note"}, "category": "_exclude"},
                {"conditions": {"subject_is": "Typewritten Text", "max_length": 0}, "category": "_exclude"},
                {"conditions": {"contains": "[NOT SUBMITTED]"}, "category": "not_submitted"},
                {"conditions": {"regex": "^([A-Z]{2,4}) \\(([A-Za-z0-9 ,'-]+)\\)$"}, "category": "domain_label"},
                {"conditions": {"regex": r"\bSee\s+(page|pg\.?)\s*\d+|\bRefer\s+to\b"}, "category": "sdtm_mapping"},
                {"conditions": {"multi_line": True}, "category": "note"},
                {"conditions": {"starts_with": "Note:"}, "category": "note"},
                {"conditions": {"contains": "RELREC"}, "category": "note"},
                {"conditions": {"fallback": True}, "category": "sdtm_mapping"},
            ],
            "form_name_rules": {
                "strategy": "largest_bold_text",
                "min_font_size": 6.5,
                "exclude_patterns": [
                    "^CDISC$",
                    r"^Study\b",
                    r"^Design\s*:",
                    r"^Codelist\s*:",
                    "^Assessment Date",
                    r"\bPage\s+\d+\s+of\s+\d+\b",
                    r"^\[\d{6}",
                    r"\b\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2}\b",
                    r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}\b",
                ],
                "top_region_fraction": 0.35,
            },
            "visit_rules": [
                {"regex": "Screen(ing)?", "value": "Screening"},
                {"regex": "Baseline", "value": "Baseline"},
                {"regex": r"Week\s*(\d+)", "value": "Week {1}"},
                {"regex": "End of Study|Termination", "value": "End of Study"},
                {"regex": r"Running\s*Records?", "value": "Running Records"},
            ],
            "style_defaults": {"font": "Arial,BoldItalic", "font_size": 12.0, "domain_label_font_size": 12.0},
        }
    )
