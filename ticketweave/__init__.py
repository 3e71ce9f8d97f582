"""ticketweave: support-ticket, log and knowledge analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
