"""Readers: source trees, commands, rules, documents, git, guard logs, configuration and suites."""
