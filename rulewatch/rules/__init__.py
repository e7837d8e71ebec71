"""The rule catalogue.  Importing this package registers every rule."""

from rulewatch.rules import access, assets, audit_log, consumption, operations, participants, people  # noqa: F401
from rulewatch.rules.registry import RULES, build, rule, sql_rule  # noqa: F401
