"""Token-embedding transfer between vocabularies as Spark jobs."""

from lexigraft.plans.transfer import transfer, transfer_parts

__all__ = ["transfer", "transfer_parts"]
