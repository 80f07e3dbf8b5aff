"""qoeflow: group-based quality-of-experience analytics on Spark.

Sessions are matched to groups, per-group discounted scores are kept for
every decision, and decisions are chosen by discounted UCB or
epsilon-greedy policies.  Every operator is a DataFrame transformation:
batch operators can be checked against plain SQL and streaming operators
against their batch twins.
"""

__version__ = "0.1.0"
