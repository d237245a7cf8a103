"""marlstone.plans"""
