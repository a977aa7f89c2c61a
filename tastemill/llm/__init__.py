"""Operators for preparing training text: language, copies, mixing, decontamination, token files."""
