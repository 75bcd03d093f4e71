"""Operators for preparing language-model training text. Nothing outside this
subpackage imports it; modules are imported on demand so that Python workers
load only what they run."""
