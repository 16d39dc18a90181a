"""DataFrame operators. Import the module you need: ``from redactflow.operators import queue, qa, verify``."""
