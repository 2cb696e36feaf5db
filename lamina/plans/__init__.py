"""Planning: what an extraction would move, guards, and plan against outcome."""
