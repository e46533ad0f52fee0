"""Whole analyses: the monitoring protocol, labelled states, record identification, and the registered queries."""
