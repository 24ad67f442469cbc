"""Domain jobs: each is one DataFrame plan over the operators."""
