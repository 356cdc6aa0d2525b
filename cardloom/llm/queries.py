"""Registered queries of this subpackage. What they compute is learnt or decoded, so none has SQL; tests hold them to brute force, round trips or held-out rows."""

from __future__ import annotations

from . import boilerplate, encoding, language, leakage, packing, pii, residue, texttype, truncation

QUERIES = {"p2_found": residue.p2_found, "p2_reasons": residue.p2_reasons, "p3_found": boilerplate.p3_found, "p3_main_bodies": boilerplate.p3_main_bodies, "p4_found": language.p4_found, "p4_segments": language.p4_segments, "p5_found": truncation.p5_found, "p5_cut_shares": truncation.p5_cut_shares, "p6_found": texttype.p6_found, "p6_statistics": texttype.p6_statistics, "p7_found": encoding.p7_found, "p7_restored": encoding.p7_restored, "p8_assignment": packing.p8_assignment, "p8_fill": packing.p8_fill, "p9_found": leakage.p9_found, "p10_found": pii.p10_found, "p10_redacted": pii.p10_redacted}
SQL: dict[str, str] = {}
