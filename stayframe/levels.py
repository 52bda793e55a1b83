"""Observation levels: which key identifies an observation and which columns bound it in time."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ObsLevel:
    name: str
    key: str
    t_min: str
    t_max: str
    t_outcome: str | None = None

    @property
    def outcome(self) -> str:
        return self.t_outcome or self.t_max


PATIENT = ObsLevel("patient", "patient_id", "birthdate", "censordate")
HOSPITAL_STAY = ObsLevel("hospital_stay", "case_id", "hospital_admission", "hospital_discharge")
ICU_STAY = ObsLevel("icu_stay", "icu_stay_id", "icu_admission", "icu_discharge")
PROCEDURE = ObsLevel("procedure", "procedure_id", "or_time_begin", "or_time_end", "hospital_discharge")
LEVELS = (PATIENT, HOSPITAL_STAY, ICU_STAY, PROCEDURE)


def level_named(name: str) -> ObsLevel:
    """Finds a level by name; case and a `_stay` ending don't matter."""
    wanted = name.strip().lower().removesuffix("_stay")
    for level in LEVELS:
        if level.name.removesuffix("_stay") == wanted:
            return level
    raise ValueError(f"unknown observation level {name!r}; there are {[x.name for x in LEVELS]}")
