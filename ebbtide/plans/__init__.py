"""Composite plans: experiments over ordered domains, and the queries registered for the driver."""
