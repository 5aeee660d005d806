"""tallyweave: interaction-network and event-panel analytics on Spark DataFrames."""

from tallyweave.session import build_session, cut, pin

__all__ = ["build_session", "cut", "pin"]
