"""hostweave: website profiling as Spark DataFrame jobs.

Tables of captured links, pages, fetch attempts and job history go in; clean
hosts, technology stacks, contact details, niche labels, acceptance decisions
and run history come out.  Every public function takes and returns DataFrames.
"""

from hostweave.session import get_session

__all__ = ["get_session"]
